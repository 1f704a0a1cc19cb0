from __future__ import annotations

import random

from strandlake.operators.seeds import suffix_index
from strandlake.options import SearchOptions
from strandlake.plans.search import search_fast
from strandlake.streaming.searching import late_hit_counts, query_stream, search_stream


def test_streamed_queries_get_the_hits_of_a_batch(spark, tmp_path):
    random.seed(3)
    texts = ["".join(random.choices("ABCDEFGHIJKLMNOPQRST", k=100)) for _ in range(5)]
    proteins = spark.createDataFrame([(k, f"p{k}", t) for k, t in enumerate(texts)], "protein_idx long, seq_id string, residues string")
    queries = spark.createDataFrame([(k, f"q{k}", texts[k][5:80]) for k in range(4)], "query_idx long, query_id string, residues string")
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    index = suffix_index(proteins)
    stream = search_stream(query_stream(spark, str(tmp_path / "in"), 1), proteins, index, SearchOptions(), str(tmp_path / "out"), str(tmp_path / "state"))
    stream.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search_fast(queries, proteins, index, SearchOptions()).collect()))
    assert got.count() == 4


def test_counts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = [("2023-01-01 00:10:00", 1, 5.0, True), ("2023-01-01 00:50:00", 1, float("nan"), True), ("2023-01-01 01:10:00", 1, 7.0, True), (None, 1, 9.0, True), ("2023-01-01 01:10:00", 2, 7.0, False)]
    df = spark.createDataFrame(rows, "at string, run_no int, bitscore double, is_aligned boolean").selectExpr("cast(at AS timestamp) AS emitted_at", "run_no", "bitscore", "is_aligned")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = late_hit_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    want = {(r.run_no, r.n, r.best) for r in late_hit_counts(df).collect()}
    assert {(r.run_no, r.n, r.best) for r in spark.sql("SELECT * FROM counts").collect()} == want == {(1, 2, 5.0), (1, 1, 7.0)}
