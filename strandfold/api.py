"""Whole runs over files: dedup, extract, and merging of pairs, with reports."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.functions.cigar import check_window
from strandfold.operators import bundles, consensus, coverage, extract, pairs
from strandfold.operators.shared import stored
from strandfold.sources import bam, fasta, fastq, files, storage, tsv

log = logging.getLogger("strandfold")


def dedup_files(
    spark: SparkSession, path: str, outdir: str, method: str = "directional", separator: str = "_", percentage: float = 0.5, max_edit: int = 1, min_depth: int = 3, rev: bool = False, by_length: bool = False,
    only_group: bool = False, singletons: bool = False, paired: bool = False, split_window: int | None = None, merge_fasta: str | None = None, min_overlap: int = 3, one_file: bool = False,
) -> dict[str, str | None]:
    """Deduplicate each FASTQ or BAM file of a path: {file: None, or what went wrong with it}.

    For a file x.bam there will be x_<method>.bam (a folder of files in coordinate order, each
    with its index, or with one_file one file, which one task writes) and the file
    x_dedup_report.tsv, which is logged, too; with merge_fasta its pairs are merged and x_merge_report.tsv tells how.
    Paths may be URIs of any file system that Arrow knows.
    """
    check_window(split_window)
    if paired and merge_fasta:
        raise ValueError("mates are either joined again or merged")
    options = dict(method=method, max_edit=max_edit, percentage=percentage, min_depth=min_depth, singletons=singletons, rev=rev, only_group=only_group)
    done: dict[str, str | None] = {}
    for file, kind in files.gather(path):
        began = time.time()
        log.info("%s: dedup, %s", file, options)
        try:
            target = files.output_name(file, method, outdir)
            if kind == "bam":
                report = _dedup_bam(spark, file, target, outdir, options, separator, by_length, paired, split_window, merge_fasta, min_overlap, one_file)
            else:
                reads = bundles.keyed_fastq(fastq.read_fastq(spark, file).withColumn("qual", F.encode("qual", "ISO-8859-1")), separator, by_length)
                out, report = consensus.dedup(reads, **options, one_bundle=True)
                fastq.write_fastq(out.withColumn("qual", F.decode("qual", "ISO-8859-1")), target, gzipped=file.endswith(".gz"), files=1 if one_file else None)
                _as_one_file(target, one_file)
            name = files.report_name(file, "dedup", outdir)
            tsv.write_tsv(report, name)
            log.info("%s: done in %.0f s\n%s", file, time.time() - began, tsv.as_text(tsv.read_tsv(spark, name, ", ".join(f"{c} {t}" for c, t in report.dtypes))))
            done[file] = None
        except Exception as e:  # the other files still have their turn
            log.exception("%s failed", file)
            done[file] = str(e)
    return done


def _dedup_bam(spark, file, target, outdir, options, separator, by_length, paired, split_window, merge_fasta, min_overlap, one_file) -> DataFrame:
    every = bam.read_bam(spark, file)
    first = bundles.first_mates(every, paired, bool(merge_fasta))
    out, report = consensus.dedup(bundles.keyed_alignments(first, separator, by_length, split_window), **options)
    out = out.select(*every.columns, "bx", "ug")
    if paired:
        out = pairs.with_mates(out, every)
    elif merge_fasta:
        out = stored(out, "deduplicated")
        merged = stored(pairs.merge_pairs(out, fasta.first_record(merge_fasta)[1], min_overlap, split_window), "merged")
        tsv.write_tsv(pairs.merge_report(merged, out), files.report_name(file, "merge", outdir))
        out = merged.where("status is null or status <> 'discordant'").drop("status")
    bam.write_bam(out, target, bam.read_header(file)[0], files=1 if one_file else None)
    _as_one_file(target, one_file)
    return report


def _as_one_file(target: str, one_file: bool) -> None:
    """A written folder of one part becomes a file of the folder's name, with its index beside it."""
    if not one_file:
        return
    parts = [f for f in storage.files(target) if f.rpartition("/")[2].startswith("part-")]
    for f in parts:
        storage.move(f, f"{target}.moving" + (".bai" if f.endswith(".bai") else ""))
    storage.remove(target)
    for f in parts:
        end = ".bai" if f.endswith(".bai") else ""
        storage.move(f"{target}.moving{end}", target + end)


def coverage_files(spark: SparkSession, path: str, outdir: str) -> dict[str, str | None]:
    """Coverage per reference of each BAM of a path, in the file <name>_coverage.tsv: {file: None, or what went wrong with it}."""
    done: dict[str, str | None] = {}
    for file, kind in files.gather(path):
        if kind != "bam":
            continue
        try:
            report = coverage.coverage(bam.read_bam(spark, file), bam.references(spark, file)).orderBy("rname")
            tsv.write_tsv(report, storage.join(outdir, file.rpartition("/")[2].split(".")[0] + "_coverage.tsv"))
            done[file] = None
        except Exception as e:  # the other files still have their turn
            done[file] = str(e)
    return done


def extract_files(spark: SparkSession, r1: str, out1: str, pattern1: str | None = None, r2: str | None = None, out2: str | None = None, pattern2: str | None = None, **options) -> None:
    """Extract barcodes of one FASTQ file or of two with mates; options as in operators.extract."""
    if bool(r2) != bool(out2):
        raise ValueError("a second input needs a second output")
    one = fastq.read_fastq(spark, r1).drop("sample")
    if not r2:
        fastq.write_fastq(extract.extract(one, pattern1, **options), out1, out1.endswith(".gz"))
        return
    both = stored(extract.extract_pairs(one, fastq.read_fastq(spark, r2).drop("sample"), pattern1, pattern2, **options), "extracted")
    for i, out in ((1, out1), (2, out2)):
        side = both.select("read_ord", *[F.col(f"{c}{i}").alias(c) for c in ("qname", "descr", "seq", "qual")])
        fastq.write_fastq(side.where("seq is not null"), out, out.endswith(".gz"))
