"""FASTA files in and out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.alphabet import clean_residues, header_id


RECORDS = "file string, block long, record_no long, value string"


def parse_record(record: Column) -> tuple[Column, Column]:
    """(id, residues as they stand) of one record without its marker; the query fails on a record without a
    line break."""
    parts = F.split(record, "\n", 2)
    body = F.when(F.size(parts) == 2, parts[1]).otherwise(F.raise_error(F.concat(F.lit("no sequence after header: "), F.substring(record, 1, 60))))
    return header_id(F.concat(F.lit(">"), parts[0])), body


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as the reader splits them, the first of each file without its marker; fails where it has none."""
    seen = None
    for b in batches:
        files, blocks = (b.column(c).dictionary_encode() for c in ("file", "block"))
        codes = np.stack([x.indices.to_numpy(zero_copy_only=False) for x in (files, blocks)])
        new = np.flatnonzero(np.append(True, (codes[:, 1:] != codes[:, :-1]).any(0)))
        value = b.column("value")
        for k in new.tolist():
            where = b.column("file")[k].as_py(), b.column("block")[k].as_py()
            if where != seen and where[1] == 0:
                if not value[k].as_py().startswith(">"):
                    raise ValueError(f"not FASTA: {where[0]}")
                own = pc.equal(pa.array(np.arange(b.num_rows)), k)
                value = pc.if_else(own, pc.utf8_slice_codeunits(value, 1), value)
            seen = where
        yield pa.RecordBatch.from_arrays([*b.columns[:3], value], b.schema.names)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(`file`, `record_no`, `seq_id`, `residues`) of the records of FASTA files, residues cleaned.

    Records end at a line break followed by `>`, so files are split and read in parallel. `record_no` grows
    in file order but is not dense. A file whose first byte is not `>` fails the query, and so does a record
    without a line break. Blank residues are kept, with length 0.
    """
    raw = spark.read.text(path, lineSep="\n>").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("record_no"), "value"
    )
    seq_id, body = parse_record(F.col("value"))
    return raw.mapInArrow(_marked, RECORDS).where(F.length("value") > 0).select("file", "record_no", seq_id.alias("seq_id"), clean_residues(body).alias("residues"))


def fasta_text(seq_id: Column, residues: Column, width: int | None = None) -> Column:
    """One record as FASTA text, on lines of `width` residues if given; nulls are written as empty."""
    body = F.coalesce(residues, F.lit(""))
    if width:
        body = F.regexp_replace(body, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), F.coalesce(seq_id, F.lit("")), F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, seq_id: str, residues: str, width: int | None = None) -> None:
    df.select(fasta_text(F.col(seq_id), F.col(residues), width).alias("value")).write.mode("overwrite").text(path)
