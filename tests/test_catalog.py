from __future__ import annotations

import pytest
from oracle import SMALL, agree, connect

from strandlake.plans import catalog

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_its_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, con, name):
    agree(catalog.QUERIES[name](spark, str(SMALL)), con, catalog.SQL[name])


def test_whole_hit_list_reaches_the_limits_of_a_search(spark, tmp_path):
    """More proteins a query than a search keeps: 5,000, or 150 of a long query."""
    hits = spark.range(16_000).selectExpr("id % 2 AS query_idx", "(id div 2 * 7919) % 5500 AS db_index", "CAST((id * 104729) % 997 AS INT) AS gapless_score", "CAST(id % 50 AS INT) AS gapless_length", "1 AS suffix_counter", "CAST(id % 7 AS INT) AS suffix_offset")
    hits.write.parquet(f"{tmp_path}/hits.parquet")
    spark.createDataFrame([(0, "A" * 100), (1, "A" * 3_001)], "query_idx long, residues string").write.parquet(f"{tmp_path}/queries.parquet")
    got = catalog.QUERIES["hit_list_whole"](spark, str(tmp_path))
    assert {r.query_idx: r["count"] for r in got.groupBy("query_idx").count().collect()} == {0: 5_000, 1: 150}
    agree(got, connect(tmp_path), catalog.SQL["hit_list_whole"])


def test_entry_gives_hits(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["qseqid", "sseqid", "evalue", "bitscore"]
    assert df.count() > 0
