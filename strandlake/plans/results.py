"""Registered queries over hits, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.alphabet import INTERNAL, to_residues
from strandlake.functions.matrices import internal_matrix
from strandlake.functions.statistics import bit_score, effective_length, evalue, least_score
from strandlake.operators.alignment import align, align_tasks
from strandlake.operators.hits import top_hits, top_proteins
from strandlake.operators.intervals import merge_stretches, operation_length, operation_letter, pack_operation
from strandlake.operators.masking import segments
from strandlake.operators.report import fast_columns
from strandlake.operators.seeds import best_walk, common_prefixes, right_scores, score_places, suffix_index
from strandlake.operators.walks import walked
from strandlake.options import EXTENSION, MIN_HSP_TO_ALIGN, SearchOptions
from strandlake.plans.search import database_size, search_fast as run_fast, search_tabular as run_tabular
from strandlake.session import cut_lineage, lookup_join, spread

OPTIONS = SearchOptions()
#: Proteins that the list of best seeds keeps of each query; small enough that many queries have more.
LISTED = SearchOptions(alignments=5)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hit_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and queries with at least one aligned hit, by run."""
    hits = _table(spark, d, "hits").where("is_aligned")
    return hits.groupBy("run_no").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("query_idx").alias("n_queries"))


def hit_best_seed(spark: SparkSession, d: str) -> DataFrame:
    """One row a query and protein with its best gapless score, of equals the longest."""
    hits = _table(spark, d, "hits")
    return hits.groupBy("query_idx", "db_index").agg(
        F.max("gapless_score").alias("gapless_score"),
        F.max_by("gapless_length", F.struct("gapless_score", "gapless_length")).alias("gapless_length"),
        F.sum("suffix_counter").alias("suffix_counter"),
        (F.min("suffix_offset") < F.max("suffix_offset")).cast("int").alias("suffix_multiple"),
    )


def _hit_list(spark: SparkSession, d: str, options: SearchOptions) -> DataFrame:
    best = hit_best_seed(spark, d).where("gapless_score IS NOT NULL").withColumnRenamed("db_index", "protein_idx")
    lengths = _table(spark, d, "queries").select("query_idx", F.char_length("residues").alias("m"))
    return top_proteins(best, lengths, options).select("query_idx", "protein_idx", "gapless_score", "m")


def hit_list(spark: SparkSession, d: str) -> DataFrame:
    """The best proteins of each query by gapless score."""
    return _hit_list(spark, d, LISTED)


def hit_list_whole(spark: SparkSession, d: str) -> DataFrame:
    """The best proteins of each query by gapless score, as many as a search keeps by default."""
    return _hit_list(spark, d, OPTIONS)


def hit_statistics(spark: SparkSession, d: str) -> DataFrame:
    """E-value, bit score and lengths of every hit from its raw score."""
    size = database_size(_table(spark, d, "proteins")).first()
    n, p = F.lit(size["db_size"]), F.lit(size["db_proteins"])
    lengths = _table(spark, d, "queries").select("query_idx", F.char_length("residues").alias("m"))
    rows = _table(spark, d, "hits").join(lengths, "query_idx").where("rawscore >= 0 AND m > 0")
    m, s, aligned = F.col("m"), F.col("rawscore"), F.col("gapless_score") >= MIN_HSP_TO_ALIGN
    rows = rows.select(
        "query_idx",
        "db_index",
        "run_no",
        F.round(F.when(aligned, bit_score(s, OPTIONS)).otherwise(0.0), 6).alias("bits"),
        F.when(aligned, evalue(s, m, n, p, OPTIONS)).otherwise(1000.0).alias("e"),
        F.when(aligned, effective_length(m, n, OPTIONS)).alias("eff"),
        least_score(m, n, p, OPTIONS).alias("least"),
    )
    return rows.groupBy("query_idx", "db_index", "run_no", "bits", "eff", "least").agg(F.count(F.lit(1)).alias("n"), F.round(F.log10(F.max(F.greatest("e", F.lit(1e-300)))), 6).alias("log_e"))


def _hits_once(spark: SparkSession, d: str) -> DataFrame:
    """Each (query, protein) pair with its best aligned row."""
    hits = _table(spark, d, "hits").where("is_aligned AND NOT isnan(bitscore) AND NOT isnan(evalue) AND bitscore IS NOT NULL AND evalue IS NOT NULL")
    best = hits.groupBy("query_idx", "db_index").agg(F.max(F.struct("bitscore", (-F.col("evalue")).alias("e"), "gapless_score")).alias("b"))
    return best.select("query_idx", F.col("db_index").alias("protein_idx"), "b.bitscore", (-F.col("b.e")).alias("evalue"), "b.gapless_score", F.lit(True).alias("is_aligned"))


def reported_hits(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best hits of each query by bit score, those within the E-value."""
    return top_hits(_hits_once(spark, d), OPTIONS).select("query_idx", "protein_idx", "hit_rank")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same as lines of the short report, with the ids of both sides, counted."""
    top = top_hits(_hits_once(spark, d), OPTIONS)
    named = top.join(_table(spark, d, "queries").select("query_idx", "query_id"), "query_idx").join(_table(spark, d, "proteins").select("protein_idx", "seq_id"), "protein_idx")
    return fast_columns(named).groupBy("qseqid", "sseqid", "evalue", "bitscore").agg(F.count(F.lit(1)).alias("n"))


def missing_proteins(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals that hits name and the index lacks."""
    counts = _table(spark, d, "hits").where("db_index IS NOT NULL").groupBy("db_index").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(_table(spark, d, "proteins").select(F.col("protein_idx").alias("db_index")), "db_index", "left_anti")


def covered_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of each protein that the seeds of hits cover, merged where they overlap."""
    rows = _table(spark, d, "hits").where("send >= 0 AND gapless_length >= 0").select("db_index", F.greatest(F.col("send") - F.col("gapless_length"), F.lit(0)).alias("begin"), F.col("send").alias("end"))
    return merge_stretches(rows, ["db_index"], "begin", "end")


def packed_operations(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and operations packed and unpacked again."""
    letter = F.when(F.col("suffix_multiple") > 0, "I").otherwise("M")
    packed = _table(spark, d, "hits").where("gapless_length >= 0").select(pack_operation(F.col("gapless_length"), letter).alias("packed"))
    return packed.groupBy("packed").agg(F.count(F.lit(1)).alias("n")).select("packed", "n", operation_length(F.col("packed")).alias("length"), operation_letter(F.col("packed")).alias("letter"))


def _aligned_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = _table(spark, d, "hits").where("is_aligned AND gapless_score >= 40").select("query_idx", "db_index", "qend", "send").where("qend >= 0 AND send >= 0").distinct()
    return _with_residues(cut_lineage(pairs), spark, d)


def _with_residues(hits: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    n = hits.count()
    q = _table(spark, d, "queries").select("query_idx", F.col("residues").alias("q_residues"))
    p = _table(spark, d, "proteins").select(F.col("protein_idx").alias("db_index"), F.col("residues").alias("p_residues"))
    return lookup_join(lookup_join(hits, p, "db_index", n, "inner"), q, "query_idx", n, "inner", hits)


def seed_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ungapped pair around the places where each hit's alignment ends."""
    rows = _aligned_pairs(spark, d).where("qend < char_length(q_residues) AND send < char_length(p_residues)")
    return score_places(rows, "q_residues", "qend", "p_residues", "send", OPTIONS).select("query_idx", "db_index", "qend", "send", "score", "length")


def shared_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The residues in common from the places on where each hit's alignment ends."""
    rows = _aligned_pairs(spark, d).where("qend < char_length(q_residues) AND send < char_length(p_residues)")
    return common_prefixes(rows, "q_residues", "qend", "p_residues", "send").select("query_idx", "db_index", "qend", "send", "lcp")


def right_seed_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ungapped pair from the places on where each hit's alignment ends, without a limit to its length."""
    rows = _aligned_pairs(spark, d).where("qend < char_length(q_residues) AND send < char_length(p_residues)")
    return right_scores(rows, "q_residues", "qend", "p_residues", "send", OPTIONS).select("query_idx", "db_index", "qend", "send", "right_score", "right_length")


def aligned_scores(spark: SparkSession, d: str) -> DataFrame:
    """The local alignment of every pair of a query and a protein that hits name."""
    pairs = cut_lineage(_table(spark, d, "hits").where("is_aligned AND gapless_score >= 40 AND qend >= 0 AND send >= 0").select("query_idx", "db_index").distinct())
    rows = _with_residues(pairs, spark, d).repartition(align_tasks(spark, pairs.count()))
    return align(rows, "q_residues", "p_residues", OPTIONS).select("query_idx", "db_index", "rawscore", "qend", "send")


def masked_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Low-complexity stretches of the records of the database."""
    rows = spread(_table(spark, d, "proteins").select("protein_idx", to_residues(F.col("residues")).alias("residues")))
    return segments(rows, "protein_idx", "residues")


def found_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The best seed of each query and protein, by walking the suffixes of the database."""
    queries, proteins = _table(spark, d, "queries"), _table(spark, d, "proteins")
    if (found := walked(queries, proteins, OPTIONS)) is not None:
        return found
    return best_walk(queries, suffix_index(proteins), OPTIONS)


def search_fast(spark: SparkSession, d: str) -> DataFrame:
    """A whole search of the queries, as the short report."""
    return run_fast(_table(spark, d, "queries"), _table(spark, d, "proteins"), None, OPTIONS)


def search_tabular(spark: SparkSession, d: str) -> DataFrame:
    """A whole search of the queries, as the twelve-column report."""
    return run_tabular(_table(spark, d, "queries"), _table(spark, d, "proteins"), None, OPTIONS)


QUERIES = {
    f.__name__: f
    for f in (hit_totals, hit_best_seed, hit_list, hit_list_whole, hit_statistics, reported_hits, report_lines, missing_proteins, covered_stretches, packed_operations, seed_scores, shared_prefixes, right_seed_scores, aligned_scores, masked_stretches, found_seeds, search_fast, search_tabular)
}

_LN_K, _H, _L = math.log(OPTIONS.kappa), OPTIONS.entropy, OPTIONS.lambda_
_ONCE = """
b AS (
  SELECT query_idx, db_index, bitscore, evalue, gapless_score,
         row_number() OVER (PARTITION BY query_idx, db_index ORDER BY bitscore DESC, evalue, gapless_score DESC NULLS LAST) AS k
  FROM hits WHERE is_aligned AND NOT isnan(bitscore) AND NOT isnan(evalue) AND bitscore IS NOT NULL AND evalue IS NOT NULL
), r AS (
  SELECT query_idx, db_index AS protein_idx, bitscore, evalue,
         row_number() OVER (PARTITION BY query_idx ORDER BY bitscore DESC, gapless_score DESC NULLS LAST, db_index) AS hit_rank
  FROM b WHERE k = 1
), top AS (SELECT * FROM r WHERE hit_rank <= 100 AND evalue <= 0.001::DOUBLE)"""
_SEEDS = """
best AS (
  SELECT query_idx, db_index, max(gapless_score) AS gapless_score,
         arg_max(gapless_length, gapless_score::BIGINT * 1000000 + gapless_length) AS gapless_length,
         sum(suffix_counter)::BIGINT AS suffix_counter,
         CASE WHEN min(suffix_offset) < max(suffix_offset) THEN 1 ELSE 0 END AS suffix_multiple
  FROM hits GROUP BY query_idx, db_index
)"""
_PAIRS = """
pairs AS (
  SELECT DISTINCT query_idx, db_index, h.qend, h.send, q.residues AS q, p.residues AS p
  FROM hits h JOIN queries q USING (query_idx) JOIN proteins p ON p.protein_idx = db_index
  WHERE is_aligned AND gapless_score >= 40 AND h.qend >= 0 AND h.send >= 0 AND h.qend < length(q.residues) AND h.send < length(p.residues)
)"""
_M = internal_matrix()
_MATRIX = ", ".join(f"('{a}', '{b}', {int(_M[i, j])})" for i, a in enumerate(INTERNAL) for j, b in enumerate(INTERNAL))

SQL = {
    "hit_totals": "SELECT run_no, count(*) AS n_hits, count(DISTINCT query_idx) AS n_queries FROM hits WHERE is_aligned GROUP BY run_no",
    "hit_best_seed": f"WITH {_SEEDS} SELECT * FROM best",
    "hit_list": f"""
WITH {_SEEDS}, r AS (
  SELECT query_idx, db_index AS protein_idx, gapless_score, row_number() OVER (PARTITION BY query_idx ORDER BY gapless_score DESC, db_index) AS k FROM best WHERE gapless_score IS NOT NULL
)
SELECT query_idx, protein_idx, gapless_score, length(residues)::INTEGER AS m FROM r JOIN queries USING (query_idx)
WHERE k <= CASE WHEN length(residues) > 3000 THEN 150 ELSE 5 END""",
    "hit_list_whole": f"""
WITH {_SEEDS}, r AS (
  SELECT query_idx, db_index AS protein_idx, gapless_score, row_number() OVER (PARTITION BY query_idx ORDER BY gapless_score DESC, db_index) AS k FROM best WHERE gapless_score IS NOT NULL
)
SELECT query_idx, protein_idx, gapless_score, length(residues)::INTEGER AS m FROM r JOIN queries USING (query_idx)
WHERE k <= CASE WHEN length(residues) > 3000 THEN 150 ELSE 5000 END""",
    "hit_statistics": f"""
WITH size AS (SELECT sum(coalesce(length(residues), 0))::DOUBLE AS n, count(*)::DOUBLE AS p FROM proteins),
q AS (SELECT query_idx, length(residues)::DOUBLE AS m FROM queries WHERE length(residues) > 0),
x AS (SELECT *, ln({OPTIONS.kappa}::DOUBLE * m * n) / {_H}::DOUBLE AS c FROM q, size),
y AS (SELECT query_idx, m, c, greatest(m - c, 1.0) AS me, greatest(n - c * p, 1.0) AS ne FROM x),
z AS (
  SELECT h.query_idx, db_index, run_no, gapless_score >= 40 AS al, {_L}::DOUBLE * rawscore - {_LN_K}::DOUBLE AS nats, me, ne, m, c
  FROM hits h JOIN y USING (query_idx) WHERE rawscore >= 0
), s AS (
  SELECT query_idx, db_index, run_no, round(CASE WHEN al THEN nats / ln(2.0::DOUBLE) ELSE 0.0 END, 6) AS bits,
    CASE WHEN al THEN CASE WHEN me * ne * exp(-nats) > 1e-180::DOUBLE THEN me * ne * exp(-nats) ELSE 0.0 END ELSE 1000.0 END AS e,
    CASE WHEN al THEN trunc(m - c)::INTEGER END AS eff,
    floor((-ln({OPTIONS.evalue}::DOUBLE / me / ne) + {_LN_K}::DOUBLE) / {_L}::DOUBLE)::INTEGER AS least
  FROM z
)
SELECT query_idx, db_index, run_no, bits, eff, least, count(*) AS n, round(log10(max(greatest(e, 1e-300::DOUBLE))), 6) AS log_e FROM s GROUP BY query_idx, db_index, run_no, bits, eff, least""",
    "reported_hits": f"WITH {_ONCE} SELECT query_idx, protein_idx, hit_rank::INTEGER AS hit_rank FROM top",
    "report_lines": f"WITH {_ONCE} SELECT query_id AS qseqid, seq_id AS sseqid, printf('%.3e', evalue) AS evalue, trunc(bitscore)::INTEGER AS bitscore, count(*) AS n FROM top JOIN queries USING (query_idx) JOIN proteins USING (protein_idx) GROUP BY 1, 2, 3, 4",
    "missing_proteins": "SELECT db_index, count(*) AS n FROM hits WHERE db_index IS NOT NULL AND db_index NOT IN (SELECT protein_idx FROM proteins) GROUP BY db_index",
    "covered_stretches": """
WITH s AS (SELECT db_index, greatest(send - gapless_length, 0) AS b, send AS e FROM hits WHERE send >= 0 AND gapless_length >= 0),
m AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY db_index ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
k AS (SELECT *, sum(new) OVER (PARTITION BY db_index ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT db_index, min(b) AS begin, max(e) AS "end", count(*) AS n FROM k GROUP BY db_index, k""",
    "packed_operations": "WITH p AS (SELECT (gapless_length::BIGINT << 4) | (CASE WHEN suffix_multiple > 0 THEN 1 ELSE 0 END) AS packed FROM hits WHERE gapless_length >= 0) SELECT packed, count(*) AS n, packed >> 4 AS length, CASE packed & 15 WHEN 1 THEN 'I' ELSE 'M' END AS letter FROM p GROUP BY packed",
    "shared_prefixes": f"WITH {_PAIRS} SELECT query_idx, db_index, qend, send, len(list_filter(range(1, least(length(q) - qend, length(p) - send) + 1), lambda i: q[qend + 1:qend + i] = p[send + 1:send + i]))::INTEGER AS lcp FROM pairs",
    "right_seed_scores": f"""
WITH matrix(a, b, v) AS (VALUES {_MATRIX}), {_PAIRS},
steps AS (
  SELECT query_idx, db_index, qend, send, i, q[qend + 1 + i] AS a, p[send + 1 + i] AS b
  FROM (SELECT *, unnest(range(0, least(length(q) - qend, length(p) - send))) AS i FROM pairs)
), sums AS (SELECT *, sum(v) OVER (PARTITION BY query_idx, db_index, qend, send ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM steps JOIN matrix USING (a, b)),
best AS (SELECT query_idx, db_index, qend, send, max(s) AS top, max(s * 1000000 + i) % 1000000 AS spot FROM sums WHERE s >= 0 GROUP BY ALL)
SELECT query_idx, db_index, qend, send,
  CASE WHEN least(length(q) - qend, length(p) - send) >= 3 AND q[qend + 1] = p[send + 1] THEN coalesce(top, 0) ELSE 0 END::INTEGER AS right_score,
  CASE WHEN least(length(q) - qend, length(p) - send) >= 3 AND q[qend + 1] = p[send + 1] THEN coalesce(spot, 0) ELSE -1 END::INTEGER AS right_length
FROM pairs LEFT JOIN best USING (query_idx, db_index, qend, send)""",
    "seed_scores": f"""
WITH matrix(a, b, v) AS (VALUES {_MATRIX}), {_PAIRS}, steps AS (
  SELECT query_idx, db_index, qend, send, 1 AS side, i, q[qend + 1 + i] AS a, p[send + 1 + i] AS b
  FROM (SELECT *, unnest(range(0, least(length(q) - qend, length(p) - send, {EXTENSION}))) AS i FROM pairs)
  UNION ALL
  SELECT query_idx, db_index, qend, send, -1, i, q[qend + 1 - i], p[send + 1 - i]
  FROM (SELECT *, unnest(range(1, least(qend, send + 1, {EXTENSION}))) AS i FROM pairs)
), sums AS (SELECT *, sum(v) OVER (PARTITION BY query_idx, db_index, qend, send, side ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM steps JOIN matrix USING (a, b)),
best AS (SELECT query_idx, db_index, qend, send, side, max(s) AS top, max(s * 1000 + i) % 1000 AS spot FROM sums WHERE s >= 0 GROUP BY ALL),
total AS (SELECT query_idx, db_index, qend, send, sum(top) AS score, sum(spot) AS length FROM best GROUP BY ALL)
SELECT query_idx, db_index, qend, send, CASE WHEN q[qend + 1] = p[send + 1] THEN coalesce(score, 0) ELSE 0 END::INTEGER AS score,
  CASE WHEN q[qend + 1] = p[send + 1] THEN coalesce(length, 0) ELSE -1 END::INTEGER AS length
FROM pairs LEFT JOIN total USING (query_idx, db_index, qend, send)""",
}
