"""From reads to counted and ranked UMIs per bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandfold.functions import cigar as C
from strandfold.functions.sequence import ascii_sum, quality_sum, umi_from_name
from strandfold.schema import BUNDLE, with_bundle

REVERSE, MATE_UNMAPPED, SECOND = 16, 8, 128


def first_mates(reads: DataFrame, paired: bool = False, merge_pairs: bool = False) -> DataFrame:
    """Without second mates (unless pairs are to be merged) and, if paired, without reads whose mate is unmapped.

    Other flags aren't looked at; reads without a reference never take part.
    """
    out = reads.where("chr is not null and chr >= 0")
    if not merge_pairs:
        out = out.where(F.col("flag").bitwiseAND(F.lit(SECOND)) == 0)
    if paired:
        out = out.where(F.col("flag").bitwiseAND(F.lit(MATE_UNMAPPED)) == 0)
    return out


def keyed_alignments(reads: DataFrame, separator: str = "_", by_length: bool = False, split_window: int | None = None) -> DataFrame:
    """Aligned reads with umi, quality sum and bundle columns."""
    ops = C.operations(F.col("cigar"))
    reverse = F.col("flag").bitwiseAND(F.lit(REVERSE)) != 0
    out = reads.withColumn("umi", umi_from_name(F.col("qname"), separator)).withColumn("qual_sum", quality_sum(F.col("qual"))).withColumn("reverse", reverse).withColumn("__ops", ops)
    out = out.withColumn("grp_pos", C.group_position(F.col("pos"), F.col("__ops"), F.col("reverse")))
    out = out.withColumn("grp_len", C.query_length(F.col("__ops")) if by_length else F.lit(0).cast("long"))
    return with_bundle(out.withColumn("window_chunk", C.window_chunk(F.col("pos"), split_window)).drop("__ops"))


def keyed_fastq(reads: DataFrame, separator: str = "_", by_length: bool = False, compat: bool = False) -> DataFrame:
    """Unaligned reads: one bundle a sample, or one per length (compat: only the length's parity, as first written)."""
    n = F.char_length("seq").cast("long")
    length = (n % 2 if compat else n) if by_length else F.lit(0).cast("long")
    out = reads.withColumn("umi", umi_from_name(F.col("qname"), separator)).withColumn("qual_sum", ascii_sum(F.decode(F.col("qual"), "ISO-8859-1")))
    return with_bundle(out.drop("chr", "pos").withColumn("grp_len", length))


def umi_counts(reads: DataFrame) -> DataFrame:
    """(bundle, umi, n_reads, first_ord); the counts are first added up within each task."""
    return reads.groupBy(*BUNDLE, "umi").agg(F.count("*").alias("n_reads"), F.min("read_ord").alias("first_ord"))


def ranked(umis: DataFrame) -> DataFrame:
    """umis with rank: 1 has the most reads of its bundle; the one seen first wins ties."""
    return umis.withColumn("rank", F.row_number().over(Window.partitionBy(*BUNDLE).orderBy(F.desc("n_reads"), "first_ord", "umi")))
