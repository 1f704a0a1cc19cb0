"""The search in SQL: masking, seeds by a walk over ranked suffixes, alignments by diagonals, and the report."""

from __future__ import annotations

from strandlake.functions.alphabet import STANDARD_INTERNAL, UNKNOWN_INTERNAL
from strandlake.functions.matrices import internal_matrix
from strandlake.operators.masking import BOUND, MOST_TRIMMED, TRIGGER, WINDOW
from strandlake.options import EXTENSION, LONG_QUERY, MIN_HSP_TO_ALIGN, SearchOptions
from strandlake.plans.database import entropy_sql, windows_sql

O = SearchOptions()
_M = internal_matrix(O.matrix)
#: Scores by 25 times the first letter, plus the second one, from 1.
_SCORES = "[" + ", ".join(str(int(v)) for v in _M.ravel()) + "]"


def _scores(a: str, b: str) -> str:
    return f"list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: {_SCORES}[(ascii({a}[i]) - 65) * 25 + ascii({b}[i]) - 64])"


def _running(s: str) -> str:
    return f"list_transform(range(1, len({s}) + 1), lambda k: list_sum({s}[1:k]))"


def _last(sums: str) -> str:
    return f"coalesce(list_max(list_transform(range(1, len({sums}) + 1), lambda k: CASE WHEN {sums}[k] = greatest(0, list_max({sums})) THEN k ELSE 0 END)), 0)"


#: Suffixes of the records in order, those of the queries placed among them, and a walk from each place to either
#: side that goes on as long as the pair around the two places is long enough.
_WALK = f"""
db AS (
  SELECT row_number() OVER (ORDER BY substr(residues, i + 1, {EXTENSION}), protein_idx, i) - 1 AS r, protein_idx, i AS p_start, substr(residues, i + 1, {EXTENSION}) AS pa,
         reverse(substr(residues, greatest(i - {EXTENSION - 1}, 0) + 1, i - greatest(i - {EXTENSION - 1}, 0))) AS pb
  FROM (SELECT protein_idx, residues, unnest(range(0, length(residues))) AS i FROM proteins)
), qs AS (
  SELECT query_idx, i AS q_start, substr(residues, i + 1, {EXTENSION}) AS qa,
         CASE WHEN i > 1 THEN reverse(substr(residues, greatest(i - {EXTENSION - 1}, 1) + 1, i - greatest(i - {EXTENSION - 1}, 1))) ELSE '' END AS qb
  FROM (SELECT query_idx, residues, unnest(range(0, length(residues) - {O.min_length})) AS i FROM queries WHERE length(residues) > {O.min_length})
  WHERE residues[i + 1] <> '{UNKNOWN_INTERNAL}'
), placed AS (
  SELECT query_idx, q_start, qa, qb, kind, sum(kind) OVER (ORDER BY qa, kind ROWS UNBOUNDED PRECEDING)::BIGINT AS place
  FROM (SELECT 0 AS kind, query_idx, q_start, qa, qb FROM qs UNION ALL SELECT 1, NULL, NULL, pa, NULL FROM db)
), walk(query_idx, q_start, qa, qb, dir, pos, protein_idx, score, length) AS (
  SELECT query_idx, q_start, qa, qb, dir, place - CASE WHEN dir < 0 THEN 1 ELSE 0 END, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM placed, (VALUES (1), (-1)) d(dir) WHERE kind = 0
  UNION ALL
  SELECT query_idx, q_start, qa, qb, dir, pos + dir, protein_idx, score, length FROM (
    SELECT *, greatest(0, list_max(ra)) + coalesce(greatest(0, list_max(rb)), 0) AS score, greatest({_last("ra")} - 1, 0) + {_last("rb")} AS length FROM (
      SELECT *, {_running("sa")} AS ra, {_running("sb")} AS rb FROM (
        SELECT w.query_idx, w.q_start, w.qa, w.qb, w.dir, w.pos, db.protein_idx, {_scores("w.qa", "db.pa")} AS sa, {_scores("w.qb", "db.pb")} AS sb
        FROM walk w JOIN db ON db.r = w.pos WHERE w.qa[1] = db.pa[1]))) WHERE length >= {O.min_length}
), found AS (
  SELECT query_idx, protein_idx, max(score)::INTEGER AS gapless_score, (max(score * 1000 + length) % 1000)::INTEGER AS gapless_length, count(*)::INTEGER AS suffix_counter,
    (999999 - max((score * 1000 + length) * 1000000 + 999999 - q_start) % 1000000)::INTEGER AS suffix_offset, CASE WHEN min(q_start) < max(q_start) THEN 1 ELSE 0 END AS suffix_multiple
  FROM walk WHERE protein_idx IS NOT NULL GROUP BY query_idx, protein_idx
)"""


def _aligned(pairs: str) -> str:
    """Pairs (a, b) aligned diagonal by diagonal, with scores of pairs and of gaps along either text by query place."""
    return f"""
letters AS (
  SELECT a, b, list_transform(range(1, length(q.residues) + 1), lambda i: (ascii(q.residues[i]) - 65) * 25) AS q, list_transform(range(1, length(p.residues) + 1), lambda i: ascii(p.residues[i]) - 64) AS t
  FROM ({pairs}) JOIN queries q ON q.query_idx = a JOIN proteins p ON p.protein_idx = b
), dp(a, b, q, t, d, h1, h2, e, f, best) AS (
  SELECT a, b, q, t, 1, list_transform(q, lambda x: 0), list_transform(q, lambda x: 0), list_transform(q, lambda x: -9999), list_transform(q, lambda x: -9999), 0::BIGINT FROM letters
  UNION ALL
  SELECT a, b, q, t, d + 1, h, h1, e, f,
    CASE WHEN list_max(h) * 10000000000::BIGINT > best THEN greatest(best, list_max(list_transform(h, lambda x, i: x * 10000000000::BIGINT - (d + 1 - i) * 100000 - i))) ELSE best END FROM (
    SELECT *, list_transform(q, lambda x, i: CASE WHEN d + 1 - i BETWEEN 1 AND len(t) THEN greatest(0, coalesce(h2[i - 1], 0) + {_SCORES}[x + t[d + 1 - i]], e[i], f[i]) ELSE 0 END) AS h FROM (
      SELECT a, b, q, t, d, h1, h2, best,
        list_transform(e, lambda x, i: greatest(x - {O.gap_extend}, h1[i] - {O.gap_open})) AS e,
        [-9999] || list_transform(f[:-2], lambda x, i: greatest(x - {O.gap_extend}, h1[i] - {O.gap_open})) AS f
      FROM dp WHERE d < len(q) + len(t)))
), scored AS (SELECT a, b, best, CASE WHEN best = 0 THEN 0 ELSE (best + 9999999999) // 10000000000 END AS s FROM dp WHERE d >= len(q) + len(t)),
aligned AS (
  SELECT a AS query_idx, b AS protein_idx, s::INTEGER AS rawscore,
    CASE WHEN s = 0 THEN -1 ELSE (s * 10000000000 - best) % 100000 - 1 END::INTEGER AS qend, CASE WHEN s = 0 THEN -1 ELSE (s * 10000000000 - best) // 100000 - 1 END::INTEGER AS send
  FROM scored
)"""


def _ln(k: str) -> str:
    return f"round(lgamma({k} + 1), 6)"


_LETTERS = "[" + ", ".join(f"'{x}'" for x in STANDARD_INTERNAL) + "]"
_COUNTS = f"list_transform({_LETTERS}, lambda x: length(w) - length(replace(w, x, '')))"
_MULTIPLES = f"list_sum(list_transform(list_distinct(c), lambda k: {_ln('len(list_filter(c, lambda x: x = k))')}))"
#: How likely the composition `c` of a window `w` is by chance.
_LIKELY = f"round({_ln('20')} - {_MULTIPLES} + {_ln('length(w)')} - list_sum(list_transform(c, lambda k: {_ln('k')})) - length(w) * ln(20.0::DOUBLE), 9)"
_LIKELY_AT = f"list_transform([substr(part, a + 1, n)], lambda w: list_transform([{_COUNTS}], lambda c: {_LIKELY})[1])[1]"
_WIDTHS = f"range(greatest(1, length(part) - {MOST_TRIMMED}) + 1, length(part) + 1)"
#: Each row looks in a piece of a record, up to `hi`, for the first window from `i` on that is low in entropy; the next
#: rows look behind the stretch that it gives and, where it lies before its trimmed stretch, in what is left before.
_STRETCHES = f"""
x AS ({windows_sql("proteins", "protein_idx", WINDOW)}),
entropies AS (SELECT protein_idx, list({entropy_sql()} ORDER BY start) AS h FROM x GROUP BY protein_idx),
work(protein_idx, residues, h, hi, i, first, last) AS (
  SELECT protein_idx, residues, h, length(residues)::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM proteins JOIN entropies USING (protein_idx)
  UNION ALL
  SELECT protein_idx, residues, h, CASE side WHEN 1 THEN hi ELSE first END, CASE side WHEN 1 THEN least(high, last) + 1 ELSE low END, CASE side WHEN 1 THEN first END, CASE side WHEN 1 THEN last END FROM (
    SELECT *, low + best[3] AS first, low + best[3] - best[2] - 1 AS last, unnest(CASE WHEN s + {WINDOW - 1} < low + best[3] THEN [1, 2] ELSE [1] END) AS side FROM (
      SELECT *, list_min(flatten(list_transform({_WIDTHS}, lambda n: list_transform(range(0, length(part) - n + 1), lambda a: [{_LIKELY_AT}, -n, a])))) AS best FROM (
        SELECT *, substr(residues, low + 1, high + {WINDOW} - low) AS part FROM (
          SELECT *, coalesce(list_max(list_filter(range(i, s), lambda k: h[k + 1] > {BOUND})) + 1, i) AS low,
                 coalesce(list_min(list_filter(range(s, hi - {WINDOW - 1}), lambda k: h[k + 1] > {BOUND})), hi - {WINDOW - 1}) - 1 AS high FROM (
            SELECT protein_idx, residues, h, hi, i, list_min(list_filter(range(i, hi - {WINDOW - 1}), lambda k: h[k + 1] <= {TRIGGER})) AS s FROM work) WHERE s IS NOT NULL))))
), marked AS (
  SELECT protein_idx, first, last, CASE WHEN first <= lag(last) OVER (PARTITION BY protein_idx ORDER BY first) THEN 0 ELSE 1 END AS new FROM work WHERE first IS NOT NULL
), islands AS (SELECT *, sum(new) OVER (PARTITION BY protein_idx ORDER BY first ROWS UNBOUNDED PRECEDING) AS k FROM marked)"""


SQL = {
    "masked_stretches": f'WITH RECURSIVE {_STRETCHES} SELECT protein_idx, min(first)::INTEGER AS begin, arg_max(last, first)::INTEGER AS "end" FROM islands GROUP BY protein_idx, k',
    "found_seeds": f"WITH RECURSIVE {_WALK} SELECT * FROM found",
    "aligned_scores": f"""WITH RECURSIVE {_aligned(f"SELECT DISTINCT query_idx AS a, db_index AS b FROM hits WHERE is_aligned AND gapless_score >= {MIN_HSP_TO_ALIGN} AND qend >= 0 AND send >= 0")}
SELECT query_idx, protein_idx AS db_index, rawscore, qend, send FROM aligned""",
    "search_fast": f"""WITH RECURSIVE {_WALK},
listed AS (
  SELECT query_idx, protein_idx, gapless_score, m FROM (
    SELECT query_idx, protein_idx, gapless_score, length(residues) AS m, row_number() OVER (PARTITION BY query_idx ORDER BY gapless_score DESC, protein_idx) AS k FROM found JOIN queries USING (query_idx))
  WHERE gapless_score >= {MIN_HSP_TO_ALIGN} AND k <= CASE WHEN m > {LONG_QUERY} THEN {int(1.5 * O.hits)} ELSE {O.alignments} END
), {_aligned("SELECT query_idx AS a, protein_idx AS b FROM listed")},
size AS (SELECT sum(coalesce(length(residues), 0))::DOUBLE AS n, count(*)::DOUBLE AS p FROM proteins),
x AS (SELECT query_idx, protein_idx, gapless_score, m, n, p, {O.lambda_}::DOUBLE * rawscore - ln({O.kappa}::DOUBLE) AS nats, ln({O.kappa}::DOUBLE * m * n) / {O.entropy}::DOUBLE AS c FROM aligned JOIN listed USING (query_idx, protein_idx), size),
y AS (SELECT *, nats / ln(2.0::DOUBLE) AS bits, greatest(m - c, 1.0) * greatest(n - c * p, 1.0) * exp(-nats) AS e FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY bits DESC, gapless_score DESC, protein_idx) AS k FROM y)
SELECT query_id AS qseqid, seq_id AS sseqid, printf('%.3e', CASE WHEN e > 1e-180::DOUBLE THEN e ELSE 0.0 END) AS evalue, trunc(bits)::INTEGER AS bitscore
FROM z JOIN queries USING (query_idx) JOIN proteins USING (protein_idx) WHERE k <= {O.hits} AND e <= {O.evalue}::DOUBLE""",
}
