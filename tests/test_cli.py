from __future__ import annotations

import random

import pytest

from strandlake.__main__ import main, options, parser


def test_options_of_the_command_line():
    own = options(parser().parse_args(["search", "-f", "q", "-p", "i", "-F", "-A", "7", "-E", "10", "-M"]))
    assert (own.seeds, own.alignments, own.evalue, own.mask) == (100_000, 7, 10.0, False)
    for given, want in ((["-A", "7", "-F"], (100_000, 1_500)), (["-S", "0", "-A", "0"], (0, 0)), (["-F", "-S", "0"], (0, 1_500)), ([], (300_000, 5_000))):
        own = options(parser().parse_args(["search", "-f", "q", "-p", "i", *given]))
        assert (own.seeds, own.alignments) == want
    with pytest.raises(SystemExit):
        parser().parse_args(["search", "-f", "q"])
    with pytest.raises(ValueError):
        options(parser().parse_args(["search", "-f", "q", "-p", "i", "-l", "2"]))


def test_index_and_search(spark, tmp_path):
    random.seed(11)
    residues = ["".join(random.choices("ACDEFGHIKLMNPQRSTVWY", k=90)) for _ in range(4)]
    (tmp_path / "db.fa").write_text("".join(f">p{k}\n{r}\n" for k, r in enumerate(residues)))
    (tmp_path / "q.fa").write_text(f">q\n{residues[2][5:70]}\n")
    main(["index", "-f", str(tmp_path / "db.fa"), "-p", str(tmp_path / "ix")])
    main(["search", "-f", str(tmp_path / "q.fa"), "-p", str(tmp_path / "ix"), "-O", str(tmp_path / "out"), "-B", "-M"])
    rows = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).collect()
    assert [(r.qseqid, r.sseqid, r.pident, r.qstart, r.qend, r.sstart, r.send) for r in rows] == [("q", "p2", "100.00", "1", "65", "6", "70")]
    main(["search", "-f", str(tmp_path / "q.fa"), "-p", str(tmp_path / "ix"), "-O", str(tmp_path / "fast"), "-M", "--compat-header"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "fast")).collect()]
    assert lines[0] == "qseqid sseqid evalue bitscore" and lines[1].split("\t")[:2] == ["q", "p2"]
