"""Copies hidden by spelling: canonical keys counted in a ledger that grows batch by batch."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import HOT_SHARE, cut_lineage

LEDGER = "key binary, first_idx long, copies long, bucket int"
#: Buckets of a ledger at least, and rows for which it gets one more.
LEAST_BUCKETS, BUCKET_ROWS = 8, 1_000_000


def letters(c: Column) -> Column:
    """ASCII letters only, in one case."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


def runs(c: Column) -> Column:
    """The runs of ASCII letters and digits in one case, in sorted order, each as often as it stands."""
    cut = F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))
    return F.array_join(F.array_sort(F.split(cut, " ")), " ")


def canonical(df: DataFrame, idx: str, name: str, text: str, buckets: int, loaded: str | None = None) -> DataFrame:
    """(`idx`, `key`, `bucket`, and `loaded` if given) of every record that has something left of name and text."""
    when = F.col(loaded) if loaded else F.lit(None).cast("timestamp")
    parts = df.select(F.col(idx).alias("idx"), runs(F.col(name)).alias("n"), letters(F.col(text)).alias("t"), when.alias("loaded"))
    parts = parts.where("idx IS NOT NULL AND n <> '' AND t <> ''")
    key = F.unhex(F.sha2(F.concat_ws("\n", "n", "t"), 256)).alias("key")
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    return parts.select("idx", key, *(["loaded"] if loaded else [])).withColumn("bucket", bucket)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _state(spark: SparkSession, path: str) -> dict:
    """What the newest manifest says: its version, the batches applied, and the folder of each bucket."""
    fs, where = _folder(spark, path)
    files = [f.getPath() for f in fs.listStatus(where)] if fs.exists(where) else []
    names = sorted(f.getName() for f in files if f.getName().startswith("manifest-"))
    if not names:
        return {"version": 0, "applied": [], "folders": {}}
    text = spark.read.text(f"{path}/{names[-1]}", wholetext=True).first()[0]
    return json.loads(text)


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Write a manifest under the next version: the one step by which a batch takes effect."""
    fs, where = _folder(spark, f"{path}/manifest-{state['version']:09d}")
    _, draft = _folder(spark, f"{path}/draft-{uuid.uuid4()}")
    stream = fs.create(draft, False)
    stream.write(json.dumps(state).encode())
    stream.close()
    if not fs.rename(draft, where):
        raise RuntimeError(f"another batch has been added to {path}")


def _read(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of some buckets, or all."""
    folders = {int(b): f for b, f in state["folders"].items() if buckets is None or int(b) in buckets}
    if not folders:
        return spark.createDataFrame([], LEDGER)
    rows: DataFrame | None = None
    for folder in sorted(set(folders.values())):
        own = spark.read.schema(LEDGER).parquet(f"{path}/{folder}").where(F.col("bucket").isin([b for b, f in folders.items() if f == folder]))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def add_batch(spark: SparkSession, path: str, keys: DataFrame, batch_no: int) -> None:
    """Add one batch of canonical keys to the ledger at `path`, rewriting only the buckets it meets.

    The batch is aggregated by key, full-outer-joined with the ledger's rows of the same buckets, and the
    counts are added; the smallest index stays the representative. New rows are written beside the old ones,
    and a manifest that is put in place in one step makes them current, so a lost job leaves the ledger as it
    was. The manifest names the batches applied: adding one of them again changes nothing.
    """
    state = _state(spark, path)
    if batch_no in state["applied"]:
        return
    batch = cut_lineage(keys.groupBy("bucket", "key").agg(F.min("idx").alias("b_first"), F.count(F.lit(1)).alias("b_copies")))
    sizes = {r[0]: r[1] for r in batch.groupBy("bucket").count().collect()}  # at most as many as there are buckets
    folder = f"rows-{uuid.uuid4()}"
    if sizes:
        old = _read(spark, path, state, list(sizes)).select("bucket", "key", F.col("first_idx").alias("o_first"), F.col("copies").alias("o_copies"))
        both = old.join(batch, ["bucket", "key"], "full_outer")
        copies = F.coalesce("o_copies", F.lit(0)) + F.coalesce("b_copies", F.lit(0))
        merged = both.select("key", F.least("o_first", "b_first").alias("first_idx"), copies.alias("copies"), "bucket")
        files = -(-max(sizes.values()) // BUCKET_ROWS)
        merged = merged.repartition(F.col("bucket"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(files)))
        merged.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    changed = {str(b): folder for b in sizes}
    _commit(spark, path, {"version": state["version"] + 1, "applied": [*state["applied"], batch_no], "folders": state["folders"] | changed})


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete the rows that the newest manifest does not name; no batch may be under way."""
    state = _state(spark, path)
    fs, where = _folder(spark, path)
    for found in fs.listStatus(where) if fs.exists(where) else []:
        folder = found.getPath().getName()
        if not folder.startswith("rows-"):
            continue
        for part in fs.listStatus(found.getPath()):
            name = part.getPath().getName()
            if name.startswith("bucket=") and state["folders"].get(name.removeprefix("bucket=")) != folder:
                fs.delete(part.getPath(), True)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(`key`, `first_idx`, `copies`) of every canonical record seen so far."""
    return _read(spark, path, _state(spark, path)).select("key", "first_idx", "copies")


def hidden_copies(df: DataFrame, ledger: DataFrame, idx: str, name: str, text: str, buckets: int) -> DataFrame:
    """One row (`first_idx`, `copy_idx`) for each record that is not the first of its group."""
    return copies_of(canonical(df, idx, name, text, buckets), ledger)


def copies_of(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """The same from canonical keys. The ledger knows which keys own more than a HOT_SHARE-th of all rows; there
    are HOT_SHARE of them at most, and their few rows are broadcast. The others take the ordinary join."""
    more = ledger.where("copies > 1")
    n = ledger.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") > n // HOT_SHARE
    marked = keys.select("idx", "key").join(F.broadcast(more.where(hot).select("key", F.col("first_idx").alias("_first"))), "key", "left")
    rest = marked.where("_first IS NULL").drop("_first").join(more.where(~hot).select("key", "first_idx"), "key")
    found = rest.unionByName(marked.where("_first IS NOT NULL").withColumnRenamed("_first", "first_idx"))
    return found.where("idx <> first_idx").select("first_idx", F.col("idx").alias("copy_idx"))


def bucket_count(rows: int) -> int:
    """Buckets for a ledger that is to hold about so many rows."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def fold_keys(keys: DataFrame, path: str, batches: int = 4) -> DataFrame:
    """Feed canonical keys with their load times to a new ledger at `path` in `batches` stretches of time."""
    spark = keys.sparkSession
    at = F.col("loaded")
    timed = isinstance(keys.schema["loaded"].dataType, (T.TimestampType, T.TimestampNTZType))
    value = F.unix_micros(at.cast("timestamp")) if timed else at
    cuts = keys.select(F.percentile_approx(value, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    # Bounds of the column's own type reach the scan, which then skips what other stretches hold.
    bounds = [F.timestamp_micros(F.lit(c)).cast(keys.schema["loaded"].dataType) if timed else F.lit(c) for c in sorted(set(cuts))]
    edges = [None, *bounds, None]
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = keys
        if low is not None:
            part = part.where(at > low)
        if high is not None:
            part = part.where((at <= high) | at.isNull() if low is None else at <= high)
        add_batch(spark, path, part, k)
    vacuum(spark, path)
    return read_ledger(spark, path)


def fold_batches(df: DataFrame, path: str, idx: str, name: str, text: str, loaded: str, batches: int = 4, buckets: int | None = None) -> DataFrame:
    """Feed the records of `df` to a new ledger at `path` in `batches` stretches of load time; the ledger.

    Two records are the same if their letters agree and their names hold the same runs of letters and
    digits, in any order, ignoring case. Records whose index, name or text is null, or of whose name or
    text nothing is left, are left out. Records without a load time, or with equal ones, all count: the
    stretches only set the order of adding. Repeated rows count as copies. An empty table gives an empty
    ledger. A key that a third of all records share becomes one row per input partition before the shuffle.
    Canonical keys are computed once and written; `buckets` follow the number of records where not given.
    """
    buckets = buckets or bucket_count(df.count())
    return fold_keys(cut_lineage(canonical(df, idx, name, text, buckets, loaded)), path, batches)
