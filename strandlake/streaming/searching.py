"""Queries that arrive as a stream, searched against a standing index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.options import SearchOptions
from strandlake.plans.search import search_fast
from strandlake.session import passing_tables

QUERY_SCHEMA = "query_idx long, query_id string, residues string"


def query_stream(spark: SparkSession, folder: str, files: int = 8) -> DataFrame:
    """Queries from Parquet files as they appear in `folder`, `files` at a time."""
    return spark.readStream.schema(QUERY_SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def search_stream(queries: DataFrame, proteins: DataFrame, index: DataFrame, options: SearchOptions, sink: str, checkpoint: str, search: Callable[..., DataFrame] = search_fast) -> StreamingQuery:
    """Search each batch of new queries and write its hits to `sink`, under the number of the batch.

    A query depends on no other, so there is no state and nothing is late. A batch that runs again after a
    failure overwrites what it wrote before, so each hit stands once. Stops when all files are read.
    """

    def run(batch: DataFrame, number: int) -> None:
        with passing_tables(batch.sparkSession):
            search(batch, proteins, index, options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_hit_counts(hits: DataFrame, delay: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Aligned rows and their best bit score by hour of emission and run, in event time.

    Rows without a time are left out, and so are those that come later than `delay` behind the latest
    seen; on a batch table none are late and the result is the plain aggregate.
    """
    rows = hits.where("is_aligned AND emitted_at IS NOT NULL")
    if hits.isStreaming:
        rows = rows.withWatermark("emitted_at", delay)
    slots = rows.groupBy(F.window("emitted_at", window).alias("w"), "run_no").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~F.isnan("bitscore"), F.col("bitscore"))).alias("best"))
    return slots.select(F.col("w.start").alias("slot"), "run_no", "n", "best")
