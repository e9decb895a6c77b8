"""Coverage per reference, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.functions import cigar as C


def coverage(reads: DataFrame, references: DataFrame) -> DataFrame:
    """One row per reference of (chr_name, length): reads, covered bases, coverage in percent, mean depth, base and mapping quality.

    Reads that are unmapped, secondary, failed or duplicate (flags 1796) don't count. Depth is
    added up from the starts and ends of aligned blocks, so the rows grow with the blocks
    of the reads and not with their bases.
    """
    good = reads.where((F.col("flag").bitwiseAND(F.lit(1796)) == 0) & F.col("chr_name").isNotNull())
    own = good.groupBy("chr_name").agg(F.count("*").alias("numreads"), F.avg("mapq").alias("meanmapq"))
    blocks = good.select("chr_name", "qual", F.explode(C.aligned_blocks(F.col("pos"), C.operations(F.col("cigar")))).alias("b"))
    per = blocks.groupBy("chr_name").agg(F.sum(F.col("b.len")).alias("bases"), F.sum(_block_quality()).alias("quality"))
    turns = blocks.select("chr_name", F.explode(F.array(F.struct(F.col("b.ref").alias("at"), F.lit(1).alias("d")), F.struct((F.col("b.ref") + F.col("b.len")).alias("at"), F.lit(-1).alias("d")))).alias("t"))
    covered = _covered(turns.select("chr_name", "t.at", "t.d"))
    out = references.join(own, "chr_name", "left").join(per, "chr_name", "left").join(covered, "chr_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        F.col("chr_name").alias("rname"), F.lit(1).alias("startpos"), F.col("length").alias("endpos"), zero("numreads").alias("numreads"), zero("covbases").alias("covbases"),
        (F.lit(100.0) * zero("covbases") / F.col("length")).alias("coverage"), (zero("bases") / F.col("length")).alias("meandepth"),
        F.coalesce(F.col("quality") / F.col("bases"), F.lit(0.0)).alias("meanbaseq"), F.coalesce("meanmapq", F.lit(0.0)).alias("meanmapq"),
    )


def _block_quality():
    from strandfold.functions.sequence import quality_sum

    return F.when(F.col("qual").isNotNull(), quality_sum(F.substring(F.col("qual"), (F.col("b.query") + 1).cast("int"), F.col("b.len")))).otherwise(0)


def _covered(turns: DataFrame) -> DataFrame:
    """(chr_name, covbases): positions with depth above zero.

    Depth at the start of each stretch of 2**16 bases is a running sum over the few stretches of
    a reference; inside a stretch, over its own turns. No task holds a whole reference.
    """
    from pyspark.sql import Window

    wide = 1 << 16
    t = turns.groupBy("chr_name", "at").agg(F.sum("d").alias("d")).withColumn("stretch", F.floor(F.col("at") / wide))
    sums = t.groupBy("chr_name", "stretch").agg(F.sum("d").alias("s"), F.min("at").alias("first"))
    over = Window.partitionBy("chr_name").orderBy("stretch")
    sums = sums.select("chr_name", "stretch", F.coalesce(F.sum("s").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(over).alias("then"))
    inside = Window.partitionBy("chr_name", "stretch").orderBy("at")
    d = t.join(sums, ["chr_name", "stretch"])
    d = d.select("chr_name", "at", (F.sum("d").over(inside) + F.col("before")).alias("depth"), F.coalesce(F.lead("at").over(inside), F.col("then")).alias("until"))
    return d.where("depth > 0").groupBy("chr_name").agg(F.sum(F.col("until") - F.col("at")).alias("covbases"))
