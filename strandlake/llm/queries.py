"""The registered queries of the subpackage: each runs its operator over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.components import link_groups
from strandlake.llm.encoding import garbled_texts
from strandlake.llm.leakage import find_leaks
from strandlake.llm.ledger import bucket_count, canonical, copies_of, fold_keys
from strandlake.llm.packing import pack_texts
from strandlake.llm.spans import shared_lengths
from strandlake.llm.topn import top_n_per_group
from strandlake.session import cut_lineage, ensure_checkpoint_dir


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    sound = "is_aligned AND evalue IS NOT NULL AND NOT isnan(evalue) AND bitscore IS NOT NULL AND NOT isnan(bitscore)"
    best = top_n_per_group(_table(spark, d, "hits").where(sound), ["query_idx"], [("evalue", True), ("bitscore", False)], "db_index", 10)
    return best.select("query_idx", "rank_no", "db_index")


def p1_best_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best protein of each query by raw score, with the score."""
    hits = _table(spark, d, "hits").where("is_aligned")
    return top_n_per_group(hits, ["query_idx"], [("rawscore", False)], "db_index", 1)


def _links(spark: SparkSession, d: str) -> DataFrame:
    near = _table(spark, d, "selfhits").where("is_aligned AND NOT isnan(evalue) AND evalue <= 0.001 AND query_idx <> db_index")
    pairs = near.select(F.least("query_idx", "db_index").alias("a"), F.greatest("query_idx", "db_index").alias("b")).distinct()
    known = _table(spark, d, "proteins").select(F.col("protein_idx").alias("a"))
    return pairs.join(known, "a", "left_semi").join(known.toDF("b"), "b", "left_semi")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return link_groups(_links(spark, d), "a", "b").toDF("protein_idx", "group_idx")


def p2_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("group_idx").agg(F.count(F.lit(1)).alias("n_members"), F.max("protein_idx").alias("last_idx"))


def _ledger_path(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4()}"


def _keys(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "sequences")
    return cut_lineage(canonical(rows, "record_idx", "seq_id", "residues", bucket_count(rows.count()), "loaded_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keys = _keys(spark, d)
    return copies_of(keys, fold_keys(keys, _ledger_path(spark)))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    """Every record that stands for a group, with the number of its copies."""
    return fold_keys(_keys(spark, d), _ledger_path(spark)).select("first_idx", "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_lengths(_table(spark, d, "proteins"), "protein_idx", "residues", 32)


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(_table(spark, d, "documents"), _table(spark, d, "containers"), "doc_id", "text")


def p6_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of each speech and kind of container, whether it stands in containers whole: once if it fits, else in full
    pieces and a rest one behind the other; and none of its containers holds more than it can."""
    placed = p6_packed(spark, d)
    fill = placed.groupBy("container_kind", "container_id").agg((F.sum("n_tokens") <= F.max("capacity")).alias("fits"))
    rows = placed.where("container_id IS NOT NULL").join(fill, ["container_kind", "container_id"]).unionByName(placed.where("container_id IS NULL").withColumn("fits", F.col("n_tokens") == 0))
    own = rows.groupBy("doc_id", "container_kind").agg(
        F.every("fits").alias("fits"),
        (F.count(F.lit(1)) == F.max("piece_no") + 1).alias("whole"),
        (F.sum("n_tokens") == F.max(F.col("token_start") + F.col("n_tokens"))).alias("joined"),
        F.every((F.col("token_start") == F.col("piece_no") * F.col("capacity")) & (F.col("n_tokens") <= F.col("capacity"))).alias("cut_right"),
    )
    return own.select("doc_id", "container_kind", F.expr("fits AND whole AND joined AND cut_right").alias("whole"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text", window=12, budget=1)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("distance = 0").select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items that share twelve words with at most one of them edited."""
    return _leaks(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_texts(_table(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled_texts(_table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_best_hits, p2_found, p2_group_sizes, p4_found, p4_copies, p5_found, p6_packed, p6_cover, p7_found, p7_near, p8_found, p8_restored)}
