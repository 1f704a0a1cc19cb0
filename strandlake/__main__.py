"""Command line: `python -m strandlake index|search`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from strandlake.operators.report import write_report
from strandlake.options import SearchOptions
from strandlake.plans import search as plans
from strandlake.session import cut_lineage, passing_tables
from strandlake.sources.fasta import read_fasta


class _Fast(argparse.Action):
    """Sets the limits of the fast mode; options behind it may set them anew."""

    def __init__(self, *args, **named) -> None:
        super().__init__(*args, nargs=0, **named)

    def __call__(self, parser, namespace, values, option_string=None) -> None:
        fast = SearchOptions().fast()
        namespace.seeds, namespace.alignments = fast.seeds, fast.alignments


def parser() -> argparse.ArgumentParser:
    d = SearchOptions()
    p = argparse.ArgumentParser(prog="strandlake", description="Protein homology search on Spark.")
    p.add_argument("command", choices=("index", "search"))
    p.add_argument("-f", "--file", required=True, help="FASTA file or folder")
    p.add_argument("-p", "--prefix", required=True, help="folder of the index")
    p.add_argument("-O", "--output", help="folder of the report (search)")
    p.add_argument("-H", "--hits", type=int, default=d.hits)
    p.add_argument("-E", "--evalue", type=float, default=d.evalue)
    p.add_argument("-o", "--gapopen", type=int, default=d.gap_open)
    p.add_argument("-e", "--gapextend", type=int, default=d.gap_extend)
    p.add_argument("-m", "--matrix", default=d.matrix)
    p.add_argument("--matrix-dir", help="folder of matrix files other than those built in")
    p.add_argument("-a", "--lambda", dest="lambda_", type=float, default=d.lambda_)
    p.add_argument("-k", "--kappa", type=float, default=d.kappa)
    p.add_argument("-g", "--entropy", type=float, default=d.entropy)
    p.add_argument("-l", "--minlength", type=int, default=d.min_length)
    p.add_argument("-s", "--minscore", type=int, default=d.min_score, help="accepted, without effect")
    p.add_argument("-S", "--seeds", type=int, default=d.seeds)
    p.add_argument("-A", "--alignments", type=int, default=d.alignments)
    p.add_argument("-F", "--fast", action=_Fast, help="fewer seeds and alignments; of this, -S and -A the last one counts")
    p.add_argument("-B", "--blasttab", action="store_true", help="twelve columns instead of four")
    p.add_argument("-M", "--noseg", action="store_true", help="leave low-complexity stretches unmasked")
    p.add_argument("--compat-header", action="store_true", help="names of the header line separated by spaces")
    p.add_argument("--saturation", action="store_true", help="drop alignments whose score does not fit into 16 bits")
    p.add_argument("--work", help="folder for tables that pass away, seen by all executors; default: _work below the prefix")
    return p


def options(a: argparse.Namespace) -> SearchOptions:
    return SearchOptions(
        matrix=a.matrix,
        matrix_dir=a.matrix_dir,
        gap_open=a.gapopen,
        gap_extend=a.gapextend,
        lambda_=a.lambda_,
        kappa=a.kappa,
        entropy=a.entropy,
        min_length=a.minlength,
        min_score=a.minscore,
        seeds=a.seeds,
        alignments=a.alignments,
        hits=a.hits,
        evalue=a.evalue,
        mask=not a.noseg,
        saturation=a.saturation,
    )


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "search" and not a.output:
        p.error("search needs --output")
    own = options(a)
    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or a.work or f"{a.prefix}/_work")
    with passing_tables(spark):
        if a.command == "index":
            plans.build_index(spark, a.file, a.prefix)
            return
        proteins, suffixes = plans.load_index(spark, a.prefix)
        queries = plans.query_table(read_fasta(spark, a.file), own)
        find = plans.search_tabular if a.blasttab else plans.search_fast
        report = cut_lineage(find(queries, proteins, suffixes, own))
        write_report(report, a.output, a.compat_header)
        print("{} hits, {} queries with hits".format(*plans.run_summary(report)), file=sys.stderr)


if __name__ == "__main__":
    main()
