from __future__ import annotations

import os

from pyspark.sql import functions as F

from strandlake import session


def test_the_named_checkpoint_folder_is_kept(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    table, path = session.cut_table(spark.range(5))
    assert named in path and table.count() == 5
    session.discard(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_an_empty_table_keeps_its_columns(spark):
    table = session.cut_lineage(spark.createDataFrame([], "a long, b string"))
    assert table.columns == ["a", "b"] and table.collect() == []


def test_spread_leaves_wide_tables_alone(spark):
    assert session.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=9)
    assert session.spread(wide) is wide


def test_hot_keys_join_like_all_others(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_MIN_ROWS", 10)
    monkeypatch.setattr(session, "HOT_SHARE", 3)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    left = spark.range(90).select(F.when(F.col("id") < 60, 1).when(F.col("id") < 80, F.col("id")).cast("long").alias("k"), "id")
    right = spark.createDataFrame([(1, "hot"), (61, "cold"), (500, "none")], "k long, v string")
    for how, n in (("left", 90), ("inner", 61), ("left_semi", 61)):
        got = session.lookup_join(left, right, "k", 90, how)
        assert got.count() == n
        assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, "k", how).collect()))
