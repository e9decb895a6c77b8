"""One read per cluster by vote, or all reads tagged with their cluster; and the reports on both.

A sequence's votes in a cluster are the reads of the leader with it, plus one for each other
member that has it at all. The most votes win, then the best quality sum, then the sequence
seen first with the leader, then with the others. Of the winning sequence the read with the
highest quality sum is given out, the first on ties. Votes are counted on narrow rows; the
wide columns of reads are joined back for winners only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.functions.sequence import group_tag
from strandfold.operators.bundles import ranked, umi_counts
from strandfold.operators.clusters import clusters
from strandfold.operators.shared import stored
from strandfold.schema import BUNDLE, with_bundle

CLUSTER = [*BUNDLE, "label_rank"]


def sequence_counts(reads: DataFrame) -> DataFrame:
    """(bundle, umi, seq, n, best_q, best_ord, seen): reads of one UMI with one sequence, and the best of them."""
    best = F.struct(F.col("qual_sum").alias("q"), (-F.col("read_ord")).alias("o"))
    g = reads.groupBy(*BUNDLE, "umi", "seq").agg(F.count("*").alias("n"), F.max(best).alias("best"), F.min("read_ord").alias("seen"))
    return g.select(*BUNDLE, "umi", "seq", "n", F.col("best.q").alias("best_q"), (-F.col("best.o")).alias("best_ord"), "seen")


def sizes(labels: DataFrame) -> DataFrame:
    """(cluster, leader, n_reads, n_umis): real reads of all members."""
    return labels.groupBy(*CLUSTER, "leader").agg(F.sum("n_reads").alias("n_reads"), F.count("*").alias("n_umis"))


def winners(reads: DataFrame, labels: DataFrame, min_depth: int = 3) -> DataFrame:
    """(cluster, leader, n_reads, n_umis, seq, votes, read_ord, qual_sum): the read that stands for each cluster of at least min_depth reads."""
    counts = sequence_counts(reads).join(labels.select(*CLUSTER, "umi", "leader", "n_reads"), [*BUNDLE, "umi"])
    lead = F.col("umi") == F.col("leader")
    per = counts.groupBy(*CLUSTER, "leader", "seq").agg(
        F.sum(F.when(lead, F.col("n")).otherwise(1)).alias("votes"),
        F.max(F.struct(F.col("best_q").alias("q"), (-F.col("best_ord")).alias("o"))).alias("best"),
        F.min(F.struct(F.when(lead, 0).otherwise(1).alias("k"), F.col("seen"))).alias("seen"),
    )
    choice = F.struct("votes", F.col("best.q").alias("q"), (-F.col("seen.k")).alias("k"), (-F.col("seen.seen")).alias("s"))
    won = per.groupBy(*CLUSTER, "leader").agg(F.max_by(F.struct("seq", "votes", (-F.col("best.o")).alias("read_ord"), F.col("best.q").alias("qual_sum")), choice).alias("w"))
    passing = sizes(labels).where(F.col("n_reads") >= min_depth)
    return passing.join(won, [*CLUSTER, "leader"]).select(*CLUSTER, "leader", "n_reads", "n_umis", "w.seq", "w.votes", "w.read_ord", "w.qual_sum")


def cluster_reads(reads: DataFrame, method: str = "directional", max_edit: int = 1, percentage: float = 0.5, rev: bool = False, one_bundle: bool = False) -> DataFrame:
    """Every UMI of the keyed reads with its count, rank, label and leader."""
    return clusters(ranked(umi_counts(with_bundle(reads))), method, max_edit, percentage, rev, one_bundle=one_bundle)


def dedup(reads: DataFrame, method: str = "directional", max_edit: int = 1, percentage: float = 0.5, min_depth: int = 3, singletons: bool = False, rev: bool = False, only_group: bool = False, one_bundle: bool = False) -> tuple[DataFrame, DataFrame]:
    """(output, report) of keyed reads (umi, qual_sum, bundle columns).

    output has the columns of reads plus bx (the leader) and ug (a tag of the cluster): one
    read per cluster of at least min_depth reads, or with only_group all reads of those. What
    counts and votes need of the reads is stored once, so a file is decoded twice: for that, and
    for the reads that are given out.
    """
    min_depth = 1 if singletons else min_depth
    reads = with_bundle(reads)
    narrow = stored(reads.select(*BUNDLE, "umi", *([] if only_group else ["seq", "qual_sum"]), "read_ord"), "narrow-reads")
    labels = stored(cluster_reads(narrow, method, max_edit, percentage, rev, one_bundle), "umi-clusters")
    tag = group_tag([F.col(c) for c in BUNDLE] + [F.col("leader")])
    passing = sizes(labels).where(F.col("n_reads") >= min_depth).select(*CLUSTER)
    if only_group:
        named = labels.join(passing, CLUSTER, "left_semi").select(*BUNDLE, "umi", F.col("leader").alias("bx"), tag.alias("ug"))
        out = reads.join(named, [*BUNDLE, "umi"])
    else:
        won = winners(narrow, labels, min_depth).select(*BUNDLE, "read_ord", F.col("leader").alias("bx"), tag.alias("ug"))
        out = reads.join(won, [*BUNDLE, "read_ord"])
    out = out.select(*reads.columns, "bx", "ug")
    return out, group_report(narrow, labels, min_depth, only_group)


def group_report(reads: DataFrame, labels: DataFrame, min_depth: int = 3, only_group: bool = False) -> DataFrame:
    """One row of totals. Bundles without a passing cluster count no clusters and no UMIs.

    The smallest and largest clusters are named by their leader (and bundle order on ties).
    """
    size = sizes(labels).withColumn("passing", F.col("n_reads") >= min_depth)
    bundle = size.groupBy(*BUNDLE).agg(
        F.sum("n_umis").alias("umis"), F.count("*").alias("groups"), F.count_if("passing").alias("good"), F.sum(F.when(F.col("passing"), F.col("n_reads")).otherwise(0)).alias("kept"),
        F.min(F.when(F.col("passing"), F.struct("n_reads", *BUNDLE, "leader"))).alias("least"), F.min(F.when(F.col("passing"), F.struct((-F.col("n_reads")).alias("n"), *BUNDLE, F.col("leader")))).alias("most"),
    ).where("good > 0")
    totals = bundle.agg(
        F.coalesce(F.sum("kept" if only_group else "good"), F.lit(0)).alias("num_reads_output_file"), F.coalesce(F.sum("umis"), F.lit(0)).alias("num_total_barcodes"), F.coalesce(F.sum("groups"), F.lit(0)).alias("num_total_groups"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("num_passing_groups"), F.min("least").alias("least"), F.min("most").alias("most"),
    )
    read_in = reads.agg(F.count("*").alias("num_reads_input_file"))
    return read_in.join(totals, F.lit(True)).select(
        "num_reads_input_file", "num_reads_output_file", "num_total_barcodes", "num_total_groups", "num_passing_groups",
        F.col("least.leader").alias("min_reads_group"), F.col("least.n_reads").alias("min_reads_per_group"), F.col("most.leader").alias("max_reads_group"), (-F.col("most.n")).alias("max_reads_per_group"),
    )
