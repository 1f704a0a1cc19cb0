"""Registered queries over the records of an index, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.alphabet import INTERNAL, SIMILARITY_ORDER, STANDARD_INTERNAL, UNKNOWN_INTERNAL, clean_residues, guard_internal, header_id, letter_count, matrix_code, to_internal, to_residues
from strandlake.functions.matrices import self_scores
from strandlake.operators.masking import TRIGGER, WINDOW, entropy_windows
from strandlake.operators.placing import place_positions
from strandlake.operators.suffixes import insertion_points, query_suffixes, running_offsets, suffix_ranks
from strandlake.options import SearchOptions
from strandlake.plans.search import database_size
from strandlake.session import ensure_checkpoint_dir, spread
from strandlake.sources.fasta import read_fasta, write_fasta

MIN_LENGTH = SearchOptions().min_length
WORD = 6


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def clean_encode(spark: SparkSession, d: str) -> DataFrame:
    c = clean_residues(F.col("residues"))
    return _table(spark, d, "sequences").select("record_idx", c.alias("cleaned"), to_internal(c).alias("internal"))


def decode(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "proteins").select("protein_idx", to_residues(F.col("residues")).alias("decoded"), guard_internal(F.col("residues")).alias("guarded"))


def header_ids(spark: SparkSession, d: str) -> DataFrame:
    fasta = _table(spark, d, "raw_records").where("fmt = 'fasta' AND raw_text IS NOT NULL")
    return fasta.select("feed_no", header_id(F.split("raw_text", "\n", 2)[0]).alias("seq_id"))


def residue_composition(spark: SparkSession, d: str) -> DataFrame:
    """How often each residue stands in the database, and its row of the substitution matrix."""
    counts = [F.sum(letter_count(F.col("residues"), x)).alias(x) for x in INTERNAL]
    one = _table(spark, d, "proteins").agg(*counts)
    long = one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("residue"), F.col(x).alias("n")) for x in INTERNAL))).alias("s"))
    return long.select("s.residue", "s.n", matrix_code(F.col("s.residue")).alias("code"))


def self_score(spark: SparkSession, d: str) -> DataFrame:
    """Of each record its score against itself: the sum of the diagonal."""
    score = sum(letter_count(F.col("residues"), x) * v for x, v in self_scores().items())
    return _table(spark, d, "proteins").select("protein_idx", score.cast("long").alias("self_score"))


def protein_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where residues and headers of each record stand in the concatenated database."""
    rows = _table(spark, d, "proteins").select("protein_idx", F.char_length("residues").alias("n"), F.octet_length("seq_id").alias("h"))
    rows = running_offsets(rows, "protein_idx", {"protein_start": F.coalesce("n", F.lit(0)) + 1, "header_start": F.coalesce("h", F.lit(0)) + 1})
    return rows.select("protein_idx", "protein_start", "header_start")


def db_size(spark: SparkSession, d: str) -> DataFrame:
    return database_size(_table(spark, d, "proteins"))


def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as FASTA files and read back."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/fasta-{uuid.uuid4()}"
    write_fasta(_table(spark, d, "proteins").withColumn("decoded", to_residues(F.col("residues"))), path, "seq_id", "decoded", 60)
    return read_fasta(spark, path).select("seq_id", "residues").groupBy("seq_id", "residues").agg(F.count(F.lit(1)).alias("n"))


def position_to_protein(spark: SparkSession, d: str) -> DataFrame:
    """The record in whose stretch of the concatenated database each position falls."""
    proteins = _table(spark, d, "proteins")
    total = proteins.agg(F.max(F.col("protein_start") + F.col("protein_len") + 1)).first()[0] or 1
    places = _table(spark, d, "hits").where("send >= 0").select(F.pmod(F.col("query_idx") * 7919 + F.col("db_index") * 104729 + F.col("send"), F.lit(total)).alias("position"))
    return place_positions(places, proteins, total).groupBy("protein_idx").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


def window_entropies(spark: SparkSession, d: str) -> DataFrame:
    """The entropy of every window of twelve residues of the queries."""
    rows = entropy_windows(_table(spark, d, "queries"), "query_idx", "residues")
    return rows.select("query_idx", "start", F.round("entropy", 6).alias("entropy"))


def low_complexity_windows(spark: SparkSession, d: str) -> DataFrame:
    """Of each record the windows that would trigger masking."""
    low = entropy_windows(_table(spark, d, "proteins"), "protein_idx", "residues").where(F.col("entropy") <= TRIGGER)
    return low.groupBy("protein_idx").agg(F.count(F.lit(1)).alias("n_low"), F.min("start").alias("first_start"))


def lookup_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """The suffixes of queries that are looked up, by query."""
    rows = query_suffixes(_table(spark, d, "queries"), "query_idx", "residues", MIN_LENGTH, None)
    return rows.groupBy("query_idx").agg(F.count(F.lit(1)).alias("n"), F.min("suffix").alias("first_suffix"), F.max("start").alias("last_start"))


def suffix_rank(spark: SparkSession, d: str) -> DataFrame:
    return suffix_ranks(_table(spark, d, "proteins")).withColumnRenamed("rank", "suffix_rank")


def insertion_point(spark: SparkSession, d: str) -> DataFrame:
    return insertion_points(_table(spark, d, "queries"), _table(spark, d, "proteins"), MIN_LENGTH)


def exact_matches(spark: SparkSession, d: str) -> DataFrame:
    """Of each suffix of the queries where it falls in the suffix order, and how many suffixes begin with it."""
    return insertion_points(_table(spark, d, "queries"), _table(spark, d, "proteins"), MIN_LENGTH, matches=True)


def _words(df: DataFrame, idx: str) -> DataFrame:
    n = F.char_length("residues")
    rows = spread(df.select(idx, "residues").where(n >= WORD)).select(idx, "residues", F.explode(F.sequence(F.lit(0), n - WORD)).alias("start"))
    return rows.select(idx, F.substring("residues", F.col("start") + 1, F.lit(WORD)).alias("word"))


def word_matches(spark: SparkSession, d: str) -> DataFrame:
    """Of each query the number of places in the database that hold one of its words of six residues.
    Both sides are counted by word before they meet, so a common word is one row on either side."""
    db = _words(_table(spark, d, "proteins"), "protein_idx").groupBy("word").agg(F.count(F.lit(1)).alias("places"))
    q = _words(_table(spark, d, "queries"), "query_idx").where(~F.contains("word", F.lit(UNKNOWN_INTERNAL))).groupBy("query_idx", "word").agg(F.count(F.lit(1)).alias("times"))
    met = q.join(db, "word")
    return met.groupBy("query_idx").agg(F.sum(F.col("places") * F.col("times")).alias("n_matches"), F.count(F.lit(1)).alias("n_words"))


QUERIES = {f.__name__: f for f in (clean_encode, decode, header_ids, residue_composition, self_score, protein_offsets, db_size, fasta_roundtrip, position_to_protein, window_entropies, low_complexity_windows, lookup_suffixes, suffix_rank, insertion_point, exact_matches, word_matches)}

_LOWER = "abcdefghijklmnopqrstuvwxy"
_CLEAN = f"regexp_replace(translate(replace(residues, chr(10), ''), '{_LOWER}', '{_LOWER.upper()}'), '[^A-Y*]', 'X', 'g')"
_H = " + ".join(f"CASE WHEN length(w) - length(replace(w, '{x}', '')) > 0 THEN (length(w) - length(replace(w, '{x}', ''))) * log2(length(w) - length(replace(w, '{x}', ''))) ELSE 0 END" for x in STANDARD_INTERNAL)
_T = f"(length(w) - length(regexp_replace(w, '[{STANDARD_INTERNAL}]', '', 'g')))"
_ENTROPY = f"CASE WHEN {_T} > 0 THEN log2({_T}) - ({_H}) / {_T} ELSE 0.0 END"


def entropy_sql() -> str:
    """The entropy of a window `w`."""
    return _ENTROPY


def windows_sql(table: str, idx: str, width: int) -> str:
    return f"SELECT {idx}, i AS start, substr(residues, i + 1, {width}) AS w FROM (SELECT {idx}, residues, unnest(range(0, length(residues) - {width} + 1)) AS i FROM {table} WHERE length(residues) >= {width})"


_DB = "SELECT protein_idx, i AS start, substr(residues, i + 1) AS suffix FROM (SELECT protein_idx, residues, unnest(range(0, length(residues))) AS i FROM proteins)"
_Q = f"SELECT query_idx, i AS start, substr(residues, i + 1) AS suffix FROM (SELECT query_idx, residues, unnest(range(0, length(residues) - {MIN_LENGTH})) AS i FROM queries WHERE length(residues) > {MIN_LENGTH}) WHERE residues[i + 1] <> '{UNKNOWN_INTERNAL}'"

SQL = {
    "clean_encode": f"SELECT record_idx, {_CLEAN} AS cleaned, translate(translate({_CLEAN}, 'OU', 'XX'), '{SIMILARITY_ORDER}', '{INTERNAL}') AS internal FROM sequences",
    "decode": f"SELECT protein_idx, translate(residues, '{INTERNAL}', '{SIMILARITY_ORDER}') AS decoded, regexp_replace(residues, '[^A-Y*\\n]', '{UNKNOWN_INTERNAL}', 'g') AS guarded FROM proteins",
    "header_ids": "SELECT feed_no, regexp_extract(string_split(raw_text, chr(10))[1], '^>?([^ \\t]*)', 1) AS seq_id FROM raw_records WHERE fmt = 'fasta' AND raw_text IS NOT NULL",
    "residue_composition": "WITH l AS (SELECT unnest(string_split(residues, '')) AS residue FROM proteins), n AS (SELECT residue, count(*) AS n FROM l GROUP BY residue), letters AS (SELECT chr((64 + i)::INTEGER) AS residue, i FROM range(1, 26) t(i)) "
    "SELECT residue, coalesce(n, 0) AS n, (instr('" + "".join(INTERNAL[SIMILARITY_ORDER.index(x)] for x in "ARNDCQEGHILKMFPSTWYVBJZX*") + "', residue) - 1)::INTEGER AS code FROM letters LEFT JOIN n USING (residue)",
    "self_score": "WITH s(residue, v) AS (VALUES " + ", ".join(f"('{x}', {v})" for x, v in self_scores().items()) + "), l AS (SELECT protein_idx, unnest(string_split(residues, '')) AS residue FROM proteins) "
    "SELECT p.protein_idx, CASE WHEN any_value(p.residues) IS NULL THEN NULL ELSE coalesce(sum(v), 0)::BIGINT END AS self_score FROM proteins p LEFT JOIN l USING (protein_idx) LEFT JOIN s USING (residue) GROUP BY p.protein_idx",
    "protein_offsets": "SELECT protein_idx, coalesce(sum(coalesce(length(residues), 0) + 1) OVER w, 0)::BIGINT AS protein_start, coalesce(sum(coalesce(strlen(seq_id), 0) + 1) OVER w, 0)::BIGINT AS header_start FROM proteins WINDOW w AS (ORDER BY protein_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "db_size": "SELECT coalesce(sum(coalesce(length(residues), 0)), 0)::BIGINT AS db_size, count(*) AS db_proteins FROM proteins",
    "fasta_roundtrip": f"SELECT regexp_extract(coalesce(seq_id, ''), '^([^ \\t]*)', 1) AS seq_id, translate(coalesce(residues, ''), '{INTERNAL}', '{SIMILARITY_ORDER}') AS residues, count(*) AS n FROM proteins GROUP BY 1, 2",
    "position_to_protein": """
WITH t AS (SELECT max(protein_start + protein_len + 1) AS total FROM proteins),
p AS (SELECT (((query_idx * 7919 + db_index * 104729 + send) % total) + total) % total AS position FROM hits, t WHERE send >= 0)
SELECT protein_idx, count(*) AS n, min(position - protein_start) AS first_place, max(position - protein_start) AS last_place
FROM p JOIN proteins ON position BETWEEN protein_start AND protein_start + protein_len GROUP BY protein_idx""",
    "window_entropies": f"WITH x AS ({windows_sql('queries', 'query_idx', WINDOW)}) SELECT query_idx, start::INTEGER AS start, round({_ENTROPY}, 6) AS entropy FROM x",
    "low_complexity_windows": f"WITH x AS ({windows_sql('proteins', 'protein_idx', WINDOW)}) SELECT protein_idx, count(*) AS n_low, min(start)::INTEGER AS first_start FROM x WHERE {_ENTROPY} <= {TRIGGER}::DOUBLE GROUP BY protein_idx",
    "lookup_suffixes": f"WITH q AS ({_Q}) SELECT query_idx, count(*) AS n, min(suffix) AS first_suffix, max(start)::INTEGER AS last_start FROM q GROUP BY query_idx",
    "suffix_rank": f"WITH s AS ({_DB}) SELECT protein_idx, start::INTEGER AS start, row_number() OVER (ORDER BY suffix, protein_idx, start) - 1 AS suffix_rank FROM s",
    "insertion_point": f"WITH b AS (SELECT 1 AS kind, protein_idx AS idx, start, suffix FROM ({_DB}) UNION ALL SELECT 0, query_idx, start, suffix FROM ({_Q})), r AS (SELECT kind, idx, start, sum(kind) OVER (ORDER BY suffix, kind, idx, start ROWS UNBOUNDED PRECEDING)::BIGINT AS position FROM b) SELECT idx AS query_idx, start::INTEGER AS start, position FROM r WHERE kind = 0",
    "exact_matches": f"WITH q AS ({_Q}), b AS (SELECT 1 AS kind, protein_idx AS idx, start, suffix FROM ({_DB}) UNION ALL SELECT 0, query_idx, start, suffix FROM q UNION ALL SELECT 2, query_idx, start, suffix || '~' FROM q), r AS (SELECT kind, idx, start, sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER (ORDER BY suffix, kind, idx, start ROWS UNBOUNDED PRECEDING)::BIGINT AS position FROM b) SELECT idx AS query_idx, start::INTEGER AS start, min(position) AS position, max(position) - min(position) AS num_matches FROM r WHERE kind <> 1 GROUP BY idx, start",
    "word_matches": f"WITH d AS (SELECT w, count(*) AS places FROM ({windows_sql('proteins', 'protein_idx', WORD)}) GROUP BY w), q AS (SELECT query_idx, w, count(*) AS times FROM ({windows_sql('queries', 'query_idx', WORD)}) WHERE NOT contains(w, '{UNKNOWN_INTERNAL}') GROUP BY query_idx, w) SELECT query_idx, sum(places * times)::BIGINT AS n_matches, count(*) AS n_words FROM q JOIN d USING (w) GROUP BY query_idx",
}
