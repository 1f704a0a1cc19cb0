from __future__ import annotations

import random

import pyarrow as pa
import pytest

from strandlake.sources import records as R

CASES = [
    ("csv", None, "empty"),
    ("csv", " \n\t", "empty"),
    ("csv", "", "empty"),
    ("fasta", "\r\n", "empty"),
    ("csv", 'a,"x,1,A', "bad_quoting"),
    ("csv", 'a,"x"y,1,A', "bad_quoting"),
    ("csv", 'a,x"y,1,A', "bad_quoting"),
    ("csv", "a,1,A", "bad_columns"),
    ("csv", "a,b,c,1,A", "bad_columns"),
    ("csv", "a,b,1,A,", "bad_columns"),
    ("csv", ",x,1,A", "bad_id"),
    ("csv", "a b,x,1,A", "bad_id"),
    ("csv", "a b,x,1,A", "bad_id"),
    ("csv", "a,x,2,A1", "bad_residue"),
    ("csv", "a,x,2,A ", "bad_residue"),
    ("csv", "a,x,2,A\n", "bad_residue"),
    ("csv", "a,x,1,A\n", "bad_residue"),
    ("csv", "a,x,1,A\r", "bad_residue"),
    ("csv", "a,x,1,A\r\n", "bad_residue"),
    ("csv", 'a,"b",1,X\n', "bad_residue"),
    ("csv", "a,x,,A", "bad_length"),
    ("csv", "a,x,+1,A", "bad_length"),
    ("csv", "a,x,١,A", "bad_length"),
    ("csv", "a,x,2,A", "bad_length"),
    ("csv", "a,x,99999999999999999999999,A", "bad_length"),
    ("csv", "a,x,1,A", None),
    ("csv", "a,,0,", None),
    ("csv", '"a","x, ""y""\nz",03,"A*-"', None),
    ("csv", "a,x\ny,1,A", None),
    ("csv", "﻿a,x,1,A", None),
    ("fasta", "a\nA", "no_marker"),
    ("fasta", "﻿>a\nA", "no_marker"),
    ("fasta", ">a A", "no_sequence"),
    ("fasta", ">a\rA", "no_sequence"),
    ("fasta", "> a\nA", "bad_id"),
    ("fasta", ">\nA", "bad_id"),
    ("fasta", ">a\nA A", "bad_residue"),
    ("fasta", ">a\n>b", "bad_residue"),
    ("fasta", ">a x\r\nAC\r\nGT", None),
    ("fasta", ">a\n\n", None),
    ("xml", "<a/>", "unknown_format"),
    (None, "a", "unknown_format"),
]


@pytest.mark.parametrize(("fmt", "text", "reason"), CASES)
def test_diagnosis(fmt, text, reason):
    assert R.diagnose(fmt, text)[4] == reason


def test_operator_gives_the_diagnosis_of_each_record(spark):
    rows = [(k, fmt, text, "clash", "clash") for k, (fmt, text, _) in enumerate(CASES)] + [(None, "csv", "a,x,1,A", "", "")] * 2
    df = spark.createDataFrame(rows, "feed_no long, fmt string, raw_text string, seq_id string, reason string")
    got = R.parse_records(df, "feed_no", "fmt", "raw_text")
    assert got.columns == ["feed_no", "seq_id", "description", "seq_len", "residues", "reason"]
    found = [tuple(r) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(((r[0], *R.diagnose(r[1], r[2])) for r in rows), key=repr)
    sound, rejected = R.split_records(df, "feed_no", "fmt", "raw_text")
    assert sound.count() + rejected.count() == len(rows)
    assert "reason" not in sound.columns and rejected.columns == ["feed_no", "reason"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "n long, fmt string, raw string")
    assert R.parse_records(df, "n", "fmt", "raw").collect() == []


def test_very_long_records(spark):
    long = "A" * 3_000_000
    df = spark.createDataFrame([(1, "csv", f"a,x,{len(long)},{long}"), (2, "fasta", f">a\n{long}"), (3, "csv", f'a,"{long}')], "n long, fmt string, raw string")
    assert sorted((r.n, r.seq_len, r.reason) for r in R.parse_records(df, "n", "fmt", "raw").collect()) == [(1, 3_000_000, None), (2, 3_000_000, None), (3, None, "bad_quoting")]


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n", "\n\n", "\r\r"])
@pytest.mark.parametrize("record", ["a,x,1,A", 'a,"b",1,X', "a,,0,", 'a,x,1,"A"'])
def test_line_ends_after_a_record_are_no_part_of_it(record, end):
    for before, after in ((0, 0), (0, 3), (3, 0), (2, 2)):
        given = ["b,y,2,CD"] * before + [record + end] + ["b,y,2,CD"] * after
        rows = [r for block in R._rows("csv", pa.array(range(len(given))), pa.array(given)) for r in zip(*(c.to_pylist() for c in block), strict=True)]
        assert [r[1:] for r in sorted(rows)] == [R.diagnose("csv", t) for t in given]
        assert rows[before][5] is not None


def test_blocks_never_take_what_the_rules_reject():
    random.seed(3)
    parts = ['"', ",", "a", "B", "\n", "\r", " ", "3", "", "﻿", "*", "-", "é", '""', "1"]
    sound = ["x,d,1,A", '"x","d,e",1,A', "x,,0,", 'x,"a""b",2,AB']
    for _ in range(1500):
        texts = [random.choice(sound) if random.random() < 0.5 else "".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(random.randint(1, 6))]
        for fmt, mark in (("csv", ""), ("fasta", ">")):
            given = [mark + t for t in texts]
            blocks = R._rows(fmt, pa.array(range(len(given))), pa.array(given))
            for row in (r for block in blocks for r in zip(*(c.to_pylist() for c in block), strict=True)):
                assert row[1:] == R.diagnose(fmt, given[row[0]]), given
