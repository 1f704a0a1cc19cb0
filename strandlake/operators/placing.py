"""Positions of the concatenated database and the records they fall in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import lookup_join


def place_positions(positions: DataFrame, proteins: DataFrame, total: int, position: str = "position") -> DataFrame:
    """`positions` with the `protein_idx` of the record whose residues, or the line feed behind them, stand
    there, and the `place` within it. Positions outside the database and null ones are left out.

    A range join as an equi-join: each record stands in the buckets it reaches into, each position in one.
    Buckets are as long as a record is on average, so a position meets few records, of which its bucket
    cannot hold more than it has positions. Positions of hot buckets stay where they are.
    """
    bucket = max(1, total // max(1, proteins.count()))
    low, high = F.col("protein_start"), F.col("protein_start") + F.col("protein_len")
    reach = F.sequence(F.floor(low / bucket), F.floor(high / bucket))
    spread = proteins.select("protein_idx", "protein_start", high.alias("_end"), F.explode(reach).alias("_bucket"))
    rows = positions.where(F.col(position).between(0, total)).withColumn("_bucket", F.floor(F.col(position) / bucket))
    met = lookup_join(rows, spread, "_bucket", rows.count(), "inner").where(F.col(position).between(F.col("protein_start"), F.col("_end")))
    return met.select(*positions.columns, "protein_idx", (F.col(position) - F.col("protein_start")).alias("place"))
