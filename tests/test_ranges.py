from __future__ import annotations

import random

import pytest

from strandlake.operators import ranges, suffixes
from strandlake.operators.suffixes import insertion_points, suffix_ranks


def texts(seed: int, n: int, letters: str) -> list[tuple]:
    random.seed(seed)
    found = ["".join(random.choices(letters, k=random.choice((0, 3, 9, 17, 40)))) for _ in range(n)]
    found += found[: n // 3] + ["A" * 33, "A" * 50, None]
    return [(i, t) for i, t in enumerate(random.sample(found, len(found)))]


def split(monkeypatch, rows: int) -> None:
    monkeypatch.setattr(ranges, "RANGE_ROWS", rows)
    monkeypatch.setattr(ranges, "SAMPLED", 200)
    monkeypatch.setattr(ranges, "BATCH_ROWS", 7)


@pytest.mark.parametrize("letters", ["AB", "ABCDEFGHIJKLMNOPQRSTUVWXY", "AB\0~é山"])
def test_places_of_suffixes_against_plain_ones(spark, monkeypatch, letters):
    split(monkeypatch, 500)
    monkeypatch.setattr(suffixes, "cut_lineage", lambda df: pytest.fail("suffixes were written"))
    proteins, queries = texts(1, 60, letters), texts(2, 30, letters)
    p, q = (spark.createDataFrame(rows, f"{idx} long, residues string").repartition(3) for rows, idx in ((proteins, "protein_idx"), (queries, "query_idx")))
    order = sorted((t[s:].encode(), i, s) for i, t in proteins if t for s in range(len(t)))
    for min_length in (0, 5, 9):
        looked_up = [(i, s, t[s:].encode()) for i, t in queries if t for s in range(len(t) - min_length) if t[s] != ranges.UNKNOWN_INTERNAL]
        want = [(i, s, sum(x < t for x, _, _ in order), sum(t <= x <= t + b"~" for x, _, _ in order)) for i, s, t in looked_up]
        assert sorted(map(tuple, insertion_points(q, p, min_length, matches=True).collect())) == sorted(want)
        assert sorted(map(tuple, insertion_points(q, p, min_length).collect())) == sorted(x[:3] for x in want)


def test_ranges_and_rows_agree_where_ids_are_missing_or_repeated(spark, monkeypatch):
    split(monkeypatch, 50)
    proteins = spark.createDataFrame([(None, "ABCABC"), (3, "ABCABC"), (1, "BCABCABC"), (3, "C")], "protein_idx long, residues string")
    queries = spark.createDataFrame([(None, "ABCABC"), (3, "ABCA"), (3, "BCAB"), (4, "CABCABC")], "query_idx long, residues string")
    both = []
    for most in (ranges.MOST_BYTES, 0):
        monkeypatch.setattr(ranges, "MOST_BYTES", most)
        both.append([sorted(map(repr, df.collect())) for df in (suffix_ranks(proteins), insertion_points(queries, proteins, 2), insertion_points(queries, proteins, 2, matches=True))])
    assert both[0] == both[1] and all(both[0])


def test_no_texts_have_no_suffixes(spark):
    none = spark.createDataFrame([], "protein_idx long, residues string")
    some = spark.createDataFrame([(1, "ABCDEFGH")], "query_idx long, residues string")
    assert suffix_ranks(none).collect() == []
    assert sorted(map(tuple, insertion_points(some, none, 5).collect())) == [(1, 0, 0), (1, 1, 0), (1, 2, 0)]
    assert insertion_points(none.withColumnRenamed("protein_idx", "query_idx"), some.withColumnRenamed("query_idx", "protein_idx"), 5).collect() == []


def test_each_range_is_a_task(spark, monkeypatch):
    split(monkeypatch, 100)
    proteins = spark.createDataFrame(texts(3, 60, "ABCDE"), "protein_idx long, residues string")
    queries = spark.createDataFrame(texts(4, 30, "ABCDE"), "query_idx long, residues string")
    assert insertion_points(queries, proteins, 5).rdd.getNumPartitions() > 5


def test_ranks_of_suffixes_against_plain_ones(spark, monkeypatch):
    split(monkeypatch, 500)
    monkeypatch.setattr(suffixes, "cut_lineage", lambda df: pytest.fail("suffixes were written"))
    rows = texts(5, 60, "AB\0é")
    order = sorted((t[s:].encode(), i, s) for i, t in rows if t for s in range(len(t)))
    ranked = suffix_ranks(spark.createDataFrame(rows, "protein_idx long, residues string"))
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, ranked.collect())) == sorted((i, s, k) for k, (_, i, s) in enumerate(order))


def test_insertion_points_move_no_suffixes(spark):
    proteins = spark.createDataFrame([(1, "ABCABC"), (2, "BCABCABC")], "protein_idx long, residues string")
    queries = spark.createDataFrame([(1, "CABCABC")], "query_idx long, residues string")
    found = insertion_points(queries, proteins, 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 0, 13), (1, 1, 2)]
