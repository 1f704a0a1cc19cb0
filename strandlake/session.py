"""Session helpers: where lineage is cut, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many rows a task takes a whole join at once, so no key needs a way of its own.
HOT_MIN_ROWS = 20_000
#: A key is hot from this fraction of all rows on, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1_000
#: Tables up to this size are broadcast, as Spark does by default.
BROADCAST_BYTES = 10 << 20
#: Parts that the rows of a hot key are spread over.
SALTS = 64


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder named by spark.checkpoint.dir. Where none is named, only a local session may take a
    temporary folder of its own machine; a cluster needs one that all its executors see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer partitions than there are cores, in as many; others as they are. For
    steps that make much of few rows. `df` must not hold a shuffle yet."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write `df` as a table in the shared checkpoint folder; the table, and its path for `discard`."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(_path(spark, path))
    if (made := _written.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` read back from the shared checkpoint folder: a lost executor costs no recomputation, and no
    plan grows with the number of steps before it. The table goes when the application ends."""
    return cut_table(df)[0]


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of `cut_table` that nothing reads any more."""
    _file_system(spark, path).delete(_path(spark, path), True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut_lineage` writes inside are deleted at the end, when their results have been written."""
    before = _written.set([])
    try:
        yield
    finally:
        for path in _written.get():
            discard(spark, path)
        _written.reset(before)


def estimated_bytes(df: DataFrame) -> int:
    """The size of a table as the optimizer knows it from its files; of what is computed, an upper estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(left: DataFrame, right: DataFrame, key: str, n_left: int, how: str = "left", counted: DataFrame | None = None) -> DataFrame:
    """Join `left` to `right`, which holds each `key` once or in few rows, though few keys may own most of `left`.

    Keys with more than n_left / HOT_SHARE rows are counted first, in `counted` where a narrower table with the
    same keys is at hand. There are at most HOT_SHARE of them; their rows of `left` are spread over SALTS
    parts, to each of which their rows of `right` are copied. All other keys take one part, so that each side
    is read once. Null keys find no partner: they are kept by a left join and left out by an inner or semi join.
    A `right` of at most BROADCAST_BYTES is broadcast instead.
    """
    if n_left < HOT_MIN_ROWS:
        return left.join(right, key, how)
    if estimated_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, how)
    counts = (left if counted is None else counted).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") > n_left // HOT_SHARE).select(key, F.lit(True).alias("_hot")))
    spread_out = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return spread_out.drop("_hot").join(copied, [key, "_salt"], how).drop("_salt")
