"""The suffixes of all records in order, and where a query's suffixes fall among them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.alphabet import UNKNOWN_INTERNAL
from strandlake.operators.ranges import AFTER_ALL, QUERY, QUERY_END, RECORD, sorted_ranges
from strandlake.options import EXTENSION
from strandlake.session import cut_lineage, spread

#: Rows of the suffix table in a partition.
PART_ROWS = 100_000
#: Tasks of a range sort at most; beyond, tasks sort more rows, which Spark spills.
MOST_TASKS = 20_000


def range_tasks(spark: SparkSession, rows: int, each: int = PART_ROWS) -> int:
    """Tasks for sorting so many rows: `each` in a task, but at least a task a core and MOST_TASKS at most."""
    wanted = -(-rows // each)
    return max(1, min(MOST_TASKS, wanted if rows < 1_000 else max(wanted, spark.sparkContext.defaultParallelism)))


def suffix_starts(residues: Column, shortest: int = 1) -> Column:
    """The 0-based offsets of all suffixes of at least `shortest` residues."""
    n = F.char_length(residues)
    return F.when(n >= shortest, F.sequence(F.lit(0), n - shortest)).otherwise(F.array().cast("array<int>"))


def suffixes(df: DataFrame, idx: str, residues: str, longest: int | None = EXTENSION) -> DataFrame:
    """(`idx`, `start`, `suffix`) of every suffix, cut to `longest` residues. Null residues have none."""
    key = F.substring(F.col(residues), F.col("start") + 1, F.lit(longest)) if longest else F.substr(F.col(residues), F.col("start") + 1)
    rows = spread(df.select(idx, residues))
    return rows.select(idx, residues, F.explode(suffix_starts(F.col(residues))).alias("start")).select(idx, "start", key.alias("suffix"))


def query_suffixes(df: DataFrame, idx: str, residues: str, min_length: int, longest: int | None = EXTENSION) -> DataFrame:
    """The suffixes of queries that are looked up: longer than `min_length`, and not beginning with an
    unknown or masked residue."""
    starts = suffix_starts(F.col(residues), min_length + 1)
    key = F.substring(F.col(residues), F.col("start") + 1, F.lit(longest)) if longest else F.substr(F.col(residues), F.col("start") + 1)
    rows = spread(df.select(idx, residues)).select(idx, residues, F.explode(starts).alias("start")).where(F.substring(residues, F.col("start") + 1, F.lit(1)) != UNKNOWN_INTERNAL)
    return rows.select(idx, "start", key.alias("suffix"))


def number_rows(df: DataFrame) -> DataFrame:
    """`df` with `_part`, the number of each row's partition, and `_at`, its own number in it, both from 0."""
    ids = df.withColumn("_id", F.monotonically_increasing_id())
    in_part = (1 << 33) - 1
    return ids.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND(F.lit(in_part))}).drop("_id")


def global_rank(df: DataFrame, order: list[str], rank: str, rows: int | None = None) -> DataFrame:
    """`df` with its 0-based position in the total order of the columns `order`, without a single-task window.

    Rows are range-partitioned and sorted; each partition numbers its own, and the counts of those before
    it are added. One count a partition goes to the driver.
    """
    n = rows if rows is not None else df.count()
    parts = range_tasks(df.sparkSession, n)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = cut_lineage(number_rows(placed))
    return add_bases(numbered, {"_base": F.lit(1)}).withColumn(rank, F.col("_base") + F.col("_at")).drop("_base", "_at", "_part")


def add_bases(numbered: DataFrame, what: dict[str, Column]) -> DataFrame:
    """For each name the sum of its column over all rows of the partitions before a row's own (`_part`)."""
    sums = sorted(tuple(r) for r in numbered.groupBy("_part").agg(*(F.sum(c).alias(x) for x, c in what.items())).collect())
    totals = [0] * len(what)
    bases = []
    for part, *own in sums:
        bases.append((part, *totals))
        totals = [a + b for a, b in zip(totals, own, strict=True)]
    schema = ", ".join(["_part int", *(f"`{x}` long" for x in what)])
    return numbered.join(F.broadcast(numbered.sparkSession.createDataFrame(bases or [(0, *totals)], schema)), "_part")


def suffix_ranks(proteins: DataFrame, idx: str = "protein_idx", residues: str = "residues") -> DataFrame:
    """(`idx`, `start`, `rank`): every suffix of every record in suffix order. Equal suffixes, which end
    with their records, are ordered by record and start. Texts that a task cannot hold are sorted as rows."""
    if (ranked := sorted_ranges(proteins, idx, residues)) is not None:
        return ranked
    rows = suffixes(proteins, idx, residues, None)
    return global_rank(rows, ["suffix", idx, "start"], "rank").select(idx, "start", "rank")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of suffixes of records before each row of a partition."""
    seen = 0
    for b in batches:
        db = (b.column("kind").to_numpy(zero_copy_only=False) == RECORD).astype(np.int64)
        before = seen + np.cumsum(db) - db
        seen += int(db.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before.astype(np.int64))], [*b.schema.names, "_before"])


def insertion_points(queries: DataFrame, proteins: DataFrame, min_length: int, q: str = "query_idx", p: str = "protein_idx", residues: str = "residues", matches: bool = False) -> DataFrame:
    """(`q`, `start`, `position`): for every suffix of a query that is looked up, the number of suffixes of
    records that come before it. Both sides are sorted together; suffixes of queries come first among equals.
    With `matches` also `num_matches`, the number of suffixes of records that begin with the whole suffix: those
    up to the place where the suffix would stand with a letter behind it that comes after all residues. Texts that
    a task cannot hold are sorted as rows."""
    if (found := sorted_ranges(proteins, p, residues, queries, q, min_length, matches)) is not None:
        if not matches or queries.groupBy(q).count().where("count > 1").isEmpty():
            return found
        return found.groupBy(q, "start").agg(F.min("position").alias("position"), (F.max(F.col("position") + F.col("num_matches")) - F.min("position")).alias("num_matches"))
    db = suffixes(proteins, p, residues, None).select(F.lit(RECORD).alias("kind"), F.col(p).alias("idx"), "start", "suffix")
    qs = query_suffixes(queries, q, residues, min_length, None).select(F.lit(QUERY).alias("kind"), F.col(q).alias("idx"), "start", "suffix")
    both = db.unionByName(qs)
    if matches:
        both = both.unionByName(qs.withColumns({"kind": F.lit(QUERY_END), "suffix": F.concat("suffix", F.lit(AFTER_ALL))}))
    parts = range_tasks(both.sparkSession, both.count())
    order = ["suffix", "kind", "idx", "start"]
    schema = T.StructType([*both.schema.fields, T.StructField("_before", T.LongType())])
    placed = both.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_running, schema)
    done = cut_lineage(placed.select("kind", "idx", "start", "_before").withColumn("_part", F.spark_partition_id()))
    found = add_bases(done, {"_base": (F.col("kind") == RECORD).cast("int")}).where(F.col("kind") != RECORD)
    found = found.select(F.col("idx").alias(q), "start", (F.col("_base") + F.col("_before")).alias("position"))
    if not matches:
        return found
    return found.groupBy(q, "start").agg(F.min("position").alias("position"), (F.max("position") - F.min("position")).alias("num_matches"))


def running_offsets(df: DataFrame, order: str, sizes: dict[str, Column]) -> DataFrame:
    """`df` with a column for each name of `sizes`: the sum of that size over all rows before it in the order
    of the unique column `order`. Null sizes count as 0."""
    names = [f"_size_{x}" for x in sizes]
    rows = df.withColumns({x: F.coalesce(c, F.lit(0)).cast("long") for x, c in zip(names, sizes.values(), strict=True)})
    parts = range_tasks(rows.sparkSession, rows.count())
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"_before{x}", T.LongType()) for x in names)])
    placed = rows.repartitionByRange(parts, order).sortWithinPartitions(order).mapInArrow(_sums(names), schema)
    done = cut_lineage(placed.withColumn("_part", F.spark_partition_id()))
    based = add_bases(done, {f"_base{x}": F.col(x) for x in names})
    both = {name: F.col(f"_base{x}") + F.col(f"_before{x}") for name, x in zip(sizes, names, strict=True)}
    return based.select(*df.columns, *(c.alias(name) for name, c in both.items()))


def _sums(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(columns, 0)
        for b in batches:
            new = []
            for c in columns:
                size = b.column(c).to_numpy(zero_copy_only=False)
                new.append(pa.array((totals[c] + np.cumsum(size) - size).astype(np.int64)))
                totals[c] += int(size.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *(f"_before{c}" for c in columns)])

    return run
