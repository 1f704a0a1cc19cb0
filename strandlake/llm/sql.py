"""The same queries in SQL, where SQL can express them."""

_SOUND = "is_aligned AND evalue IS NOT NULL AND NOT isnan(evalue) AND bitscore IS NOT NULL AND NOT isnan(bitscore)"

_KEYS = """
keys AS (
  SELECT record_idx,
         upper(regexp_replace(residues, '[^A-Za-z]', '', 'g')) AS t,
         array_to_string(list_sort(regexp_extract_all(lower(regexp_replace(seq_id, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+')), ' ') AS n
  FROM sequences
), groups AS (
  SELECT t, n, min(record_idx) AS first_idx, count(*) AS copies
  FROM keys WHERE record_idx IS NOT NULL AND t <> '' AND n <> '' GROUP BY t, n
)"""

_GROUPS = """
pairs AS (
  SELECT DISTINCT query_idx AS a, db_index AS b FROM selfhits
  WHERE is_aligned AND NOT isnan(evalue) AND evalue <= 0.001 AND query_idx <> db_index
    AND query_idx IN (SELECT protein_idx FROM proteins) AND db_index IN (SELECT protein_idx FROM proteins)
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a AS protein_idx, least(a, min(b)) AS group_idx FROM reach GROUP BY a)"""

_WINDOWS = """
w AS (
  SELECT protein_idx, i AS pos, substr(residues, i, 32) AS s
  FROM (SELECT protein_idx, residues, unnest(range(1, length(residues) - 30)) AS i FROM proteins)
), twice AS (SELECT s FROM w GROUP BY s HAVING min(protein_idx) < max(protein_idx)),
places AS (SELECT w.protein_idx, w.pos, lead(w.pos) OVER (PARTITION BY w.protein_idx ORDER BY w.pos) AS next FROM w JOIN twice USING (s))"""

_PAIRS = r"""
words AS (SELECT {id} AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {table}),
{name} AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM words))"""

def _edited(table: str, idx: str, item: bool) -> str:
    """Runs of words with one place open: a word changed, left out of the item, or put in between its words."""
    if item:
        cases = [("changed", 12, 1, "g[1:j - 1], ['*'], g[j + 1:12]"), ("left out", 12, 1, "g[1:j - 1], g[j + 1:12]"), ("put in", 12, 2, "g[1:j - 1], ['*'], g[j:12]")]
    else:
        cases = [("changed", 12, 1, "g[1:j - 1], ['*'], g[j + 1:12]"), ("left out", 11, 12, "g[1:11], []"), ("put in", 13, 2, "g[1:j - 1], ['*'], g[j + 1:13]")]
    words = rf"SELECT {idx} AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), 1) AS i FROM {table}"
    runs = "SELECT id, list(w) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM x"
    each = [f"SELECT id, '{kind}' AS kind, hash(array_to_string(list_concat({own}), ' ')) AS g FROM (SELECT id, g, unnest(range({low}, 13)) AS j FROM r WHERE len(g) >= {least})" for kind, least, low, own in cases]
    return f"WITH x AS ({words}), r AS ({runs}) SELECT DISTINCT * FROM ({' UNION ALL '.join(each)})"


SQL = {
    "p1_found": f"""
WITH best AS (
  SELECT query_idx, db_index, evalue, bitscore,
         row_number() OVER (PARTITION BY query_idx, db_index ORDER BY evalue, bitscore DESC) AS k
  FROM hits WHERE {_SOUND}
), ranked AS (
  SELECT query_idx, db_index, row_number() OVER (PARTITION BY query_idx ORDER BY evalue, bitscore DESC, db_index) AS rank_no
  FROM best WHERE k = 1
)
SELECT query_idx, rank_no, db_index FROM ranked WHERE rank_no <= 10""",
    "p1_best_hits": """
WITH ranked AS (
  SELECT query_idx, db_index, rawscore, row_number() OVER (PARTITION BY query_idx ORDER BY rawscore DESC NULLS LAST, db_index) AS rank_no
  FROM hits WHERE is_aligned AND db_index IS NOT NULL
)
SELECT query_idx, rank_no, db_index, rawscore FROM ranked WHERE rank_no = 1""",
    "p2_found": f"WITH RECURSIVE {_GROUPS} SELECT protein_idx, group_idx FROM groups",
    "p2_group_sizes": f"WITH RECURSIVE {_GROUPS} SELECT group_idx, count(*) AS n_members, max(protein_idx) AS last_idx FROM groups GROUP BY group_idx",
    "p4_found": f"WITH {_KEYS} SELECT first_idx, record_idx AS copy_idx FROM keys JOIN groups USING (t, n) WHERE record_idx <> first_idx",
    "p4_copies": f"WITH {_KEYS} SELECT first_idx, copies FROM groups",
    "p5_found": f"WITH {_WINDOWS} SELECT protein_idx, sum(least(32, coalesce(next - pos, 32)))::BIGINT AS shared_len FROM places GROUP BY protein_idx",
    "p6_cover": "SELECT doc_id, container_kind, true AS whole FROM documents, (SELECT DISTINCT container_kind FROM containers WHERE capacity > 0)",
    "p7_near": f"""
WITH d AS (WITH {_PAIRS.format(id="doc_id", table="documents", name="g")} SELECT * FROM g),
e AS (WITH {_PAIRS.format(id="item_id", table="eval_items", name="g")} SELECT * FROM g),
de AS ({_edited("documents", "doc_id", False)}), ee AS ({_edited("eval_items", "item_id", True)}),
pairs AS (
  SELECT d.id AS doc_id, e.id AS item_id, 0 AS distance FROM d JOIN e USING (g)
  UNION ALL SELECT de.id, ee.id, 1 FROM de JOIN ee USING (kind, g)
)
SELECT doc_id, item_id, min(distance)::INTEGER AS distance FROM pairs GROUP BY doc_id, item_id""",
    "p7_found": f"""
WITH d AS (WITH {_PAIRS.format(id="doc_id", table="documents", name="g")} SELECT * FROM g),
e AS (WITH {_PAIRS.format(id="item_id", table="eval_items", name="g")} SELECT * FROM g)
SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM d JOIN e USING (g)""",
}
