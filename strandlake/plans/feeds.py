"""Registered queries over raw record feeds, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.sources.records import parse_records


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_records(spark.read.parquet(f"{d}/raw_records.parquet"), "feed_no", "fmt", "raw_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason IS NOT NULL").select("feed_no", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason IS NULL").select("feed_no", "seq_id", "seq_len", "residues")


_FIELD = '[^",]*|"(?:[^"]|"")*"'
_FOUR = f"^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$"


def _unquoted(k: int) -> str:
    f = f"regexp_extract(raw_text, '{_FOUR}', {k})"
    return f"CASE WHEN starts_with({f}, '\"') THEN replace({f}[2:-2], '\"\"', '\"') ELSE {f} END"


_PARSED = rf"""
csv AS (
  SELECT feed_no, raw_text, {_unquoted(1)} AS seq_id, {_unquoted(3)} AS n, {_unquoted(4)} AS residues
  FROM raw_records WHERE fmt = 'csv'
), fasta AS (
  SELECT feed_no, raw_text, regexp_extract(raw_text, '^>([^ \t\r\n]*)', 1) AS seq_id,
         replace(replace(raw_text[instr(raw_text, chr(10)) + 1:], chr(10), ''), chr(13), '') AS residues
  FROM raw_records WHERE fmt = 'fasta'
), parsed AS (
  SELECT feed_no, seq_id, residues,
    CASE WHEN raw_text IS NULL OR regexp_full_match(raw_text, '\s*') THEN 'empty'
         WHEN NOT regexp_full_match(raw_text, '(?:{_FIELD})(?:,(?:{_FIELD}))*') THEN 'bad_quoting'
         WHEN length(regexp_replace(regexp_replace(raw_text, '"(?:[^"]|"")*"', '', 'g'), '[^,]', '', 'g')) <> 3 THEN 'bad_columns'
         WHEN NOT regexp_full_match(seq_id, '[^\s]+') THEN 'bad_id'
         WHEN NOT regexp_full_match(residues, '[A-Za-z*-]*') THEN 'bad_residue'
         WHEN NOT regexp_full_match(n, '[0-9]+') OR try_cast(n AS BIGINT) IS DISTINCT FROM length(residues) THEN 'bad_length'
    END AS reason FROM csv
  UNION ALL
  SELECT feed_no, seq_id, residues,
    CASE WHEN raw_text IS NULL OR regexp_full_match(raw_text, '\s*') THEN 'empty'
         WHEN raw_text[1] <> '>' THEN 'no_marker'
         WHEN instr(raw_text, chr(10)) = 0 THEN 'no_sequence'
         WHEN seq_id = '' THEN 'bad_id'
         WHEN NOT regexp_full_match(residues, '[A-Za-z*-]*') THEN 'bad_residue'
    END AS reason FROM fasta
)"""

QUERIES = {"p3_found": p3_found, "p3_loaded": p3_loaded}
SQL = {
    "p3_found": f"WITH {_PARSED} SELECT feed_no, reason FROM parsed WHERE reason IS NOT NULL",
    "p3_loaded": f"WITH {_PARSED} SELECT feed_no, seq_id, length(residues) AS seq_len, residues FROM parsed WHERE reason IS NULL",
}
