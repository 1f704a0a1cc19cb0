"""Overlapping stretches merged, and alignment operations packed into numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Operations in the order of their numbers.
OPERATIONS = "MIDNSHP=X"


def merge_stretches(df: DataFrame, by: Sequence[str], begin: str, end: str) -> DataFrame:
    """(*by, `begin`, `end`, `n`): stretches (both ends included) that share a place merged into one, with
    their number. Stretches with a null end are left out. Repeated stretches are reduced before the shuffle,
    to one row for each begin, so a group that owns most rows holds no more than its different places."""
    rows = df.where(F.col(begin).isNotNull() & F.col(end).isNotNull()).groupBy(*by, F.col(begin).alias("_b")).agg(F.max(end).alias("_e"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy("_b")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col("_b") <= reach, 0).otherwise(1))
    island = marked.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_k").agg(F.min("_b").alias(begin), F.max("_e").alias(end), F.sum("_n").alias("n")).drop("_k")


def pack_operation(length: Column, operation: Column) -> Column:
    """Length and operation letter in one number; unknown letters count as M."""
    at = F.instr(F.lit(OPERATIONS), operation)
    return F.shiftleft(length.cast("long"), 4).bitwiseOR(F.when(at > 0, at - 1).otherwise(0).cast("long"))


def operation_length(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 4)


def operation_letter(packed: Column) -> Column:
    """M for numbers that stand for no operation."""
    code = packed.bitwiseAND(F.lit(15)).cast("int")
    return F.when(code < len(OPERATIONS), F.substring(F.lit(OPERATIONS), code + 1, F.lit(1))).otherwise("M")
