"""python -m strandfold dedup | extract | coverage: the runs of api.py from a command line."""

from __future__ import annotations

import argparse
import logging
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandfold", description=__doc__)
    runs = top.add_subparsers(dest="run", required=True)
    d = runs.add_parser("dedup", help="one read a molecule, of each FASTQ or BAM file of a path")
    d.add_argument("--input", "-i", required=True)
    d.add_argument("--outdir", "-o", default="results")
    d.add_argument("--grouping-method", "-g", dest="method", choices=("directional", "acyclic", "raw"), default="directional")
    d.add_argument("--separator", "-s", default="_")
    d.add_argument("--percentage", "-p", type=float, default=0.5)
    d.add_argument("--max-edit", type=int, default=1)
    d.add_argument("--min-depth", "-d", type=int, default=3)
    d.add_argument("--min-overlap", "-b", type=int, default=3)
    d.add_argument("--split-window", "-x", type=int)
    d.add_argument("--merge-pairs", dest="merge_fasta", metavar="FASTA")
    for long, short, name in (("--rev", "-u", "rev"), ("--length", "-l", "by_length"), ("--only-group", "-v", "only_group"), ("--singletons", "-f", "singletons"), ("--paired", "-P", "paired"), ("--one-file", "-1", "one_file")):
        d.add_argument(long, short, dest=name, action="store_true")
    e = runs.add_parser("extract", help="barcodes from sequences into names")
    e.add_argument("--r1", "-i", required=True)
    e.add_argument("--out1", "-o", required=True)
    e.add_argument("--r2", "-I")
    e.add_argument("--out2", "-O")
    e.add_argument("--pattern1", "-p")
    e.add_argument("--pattern2", "-P")
    e.add_argument("--retain-seq", action="store_true")
    e.add_argument("--mask-qual", type=int, default=0)
    e.add_argument("--quality-filter", type=int, default=0)
    e.add_argument("--encoding", "-e", choices=("phred33", "phred64", "solexa"), default="phred33")
    c = runs.add_parser("coverage", help="coverage per reference, of each BAM file of a path")
    c.add_argument("--input", "-i", required=True)
    c.add_argument("--outdir", "-o", default="results")
    return top


def main(args: list[str]) -> int:
    options = vars(parser().parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    from pyspark.sql import SparkSession

    from strandfold import api

    spark = SparkSession.builder.appName("strandfold").getOrCreate()
    run = options.pop("run")
    if run == "extract":
        api.extract_files(spark, **options)
        return 0
    path, outdir = options.pop("input"), options.pop("outdir")
    done = api.dedup_files(spark, path, outdir, **options) if run == "dedup" else api.coverage_files(spark, path, outdir)
    return int(any(done.values()))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
