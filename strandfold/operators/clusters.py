"""UMI clusters: raw, acyclic and directional, as labels by closed form.

The label of a UMI is the smallest rank among those that may take it: itself (raw), itself and
its direct absorbers (acyclic), or all from which it can be reached (directional). The
directional label is a minimum over ancestors, which propagation finds in any order.

Bundles with few edges, which are nearly all, are solved many at a time inside one task
after one shuffle. A bundle with more than BIG_EDGES edges (a whole FASTQ file is one
bundle) is solved by rounds of joins instead, each a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.operators.neighbors import edges
from strandfold.operators.shared import stored
from strandfold.schema import BUNDLE

METHODS = ("raw", "acyclic", "directional")
BIG_EDGES = 2_000_000
GROUP_EDGES = 500_000
MOST_ROUNDS = 1_000


def clusters(umis: DataFrame, method: str = "directional", max_edit: int = 1, percentage: float = 0.5, rev: bool = False, big_edges: int = BIG_EDGES, one_bundle: bool = False) -> DataFrame:
    """umis (with rank) plus label_rank and leader: the cluster of each UMI is named by its smallest-rank visitor.

    leader is the UMI of smallest rank in the cluster. In the acyclic method a visitor that is
    itself absorbed keeps its own children, so a cluster may not hold the UMI it is named by.
    """
    check(method, max_edit, percentage)
    if method == "raw":
        return umis.withColumn("label_rank", F.col("rank")).withColumn("leader", F.col("umi"))
    # one edit is all that the acyclic method ever looks for
    found = edges(umis, min(1, max_edit) if method == "acyclic" else max_edit, percentage, rev, one_bundle)
    if method == "acyclic":
        labels = found.groupBy(*BUNDLE, F.col("v_rank").alias("rank")).agg(F.min("u_rank").alias("least"))
    else:
        labels = reach(found, big_edges)
    out = umis.join(labels, [*BUNDLE, "rank"], "left").withColumn("label_rank", F.least(F.col("rank"), F.coalesce("least", "rank"))).drop("least")
    leaders = out.groupBy(*BUNDLE, "label_rank").agg(F.min_by("umi", "rank").alias("leader"))
    return out.join(leaders, [*BUNDLE, "label_rank"])


def check(method: str, max_edit: int, percentage: float) -> None:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if not 0.01 <= percentage <= 1.0:
        raise ValueError("percentage must be between 0.01 and 1.0")
    if max_edit < 0:
        raise ValueError("max_edit must not be negative")


def reach(found: DataFrame, big_edges: int = BIG_EDGES) -> DataFrame:
    """(bundle, rank, least): the smallest rank from which each UMI with edges can be reached."""
    found = stored(found, "umi-edges")
    sizes = found.groupBy(*BUNDLE).agg(F.count("*").alias("k"))
    big = stored(sizes.where(F.col("k") > big_edges).select(*BUNDLE), "big-bundles")
    total = found.count()
    if big.isEmpty():
        return _small(found, total)
    return _small(found.join(big, BUNDLE, "left_anti"), total).unionByName(_large(found.join(big, BUNDLE, "left_semi")))


def _small(found: DataFrame, total: int) -> DataFrame:
    schema = found.select(*BUNDLE, F.col("u_rank").alias("rank"), F.col("u_rank").alias("least")).schema
    names = [f.name for f in schema]
    n = max(1, -(-total // GROUP_EDGES), min(found.sparkSession.sparkContext.defaultParallelism, total // 5000))

    def run(t: pa.Table) -> pa.Table:
        b = t.select(BUNDLE).to_pandas()
        which = b.groupby(BUNDLE, dropna=False, sort=False).ngroup().to_numpy().astype(np.int64)
        u, v = (t.column(c).to_numpy().astype(np.int64) for c in ("u_rank", "v_rank"))
        wide = int(max(u.max(), v.max())) + 1
        nodes, at = np.unique(np.concatenate([which * wide + u, which * wide + v]), return_inverse=True)
        x, y = at[: len(u)], at[len(u) :]
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        starts = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
        into = y[starts]
        least = nodes % wide
        while True:
            new = np.minimum(least[into], np.minimum.reduceat(least[x], starts))
            if (new == least[into]).all():
                break
            least[into] = new
        first = np.zeros(int(which.max()) + 1, dtype=np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        rows = t.select(BUNDLE).take(pa.array(first[nodes // wide]))
        return rows.append_column("rank", pa.array(nodes % wide, pa.int32())).append_column("least", pa.array(least, pa.int32()))

    grouped = found.withColumn("__g", F.pmod(F.xxhash64(*BUNDLE), F.lit(n)))
    return grouped.groupBy("__g").applyInArrow(lambda t: run(t), schema).select(*names)


def _large(found: DataFrame) -> DataFrame:
    """By rounds: each takes the smallest label of the absorbers, and the label of the label, which reaches as far; ends when none changes.

    Taking the label's label doubles the stretch of a path that a round covers.
    """
    nodes = found.select(*BUNDLE, F.explode(F.array("u_rank", "v_rank")).alias("rank")).distinct()
    labels = stored(nodes.withColumn("least", F.col("rank")), "umi-labels")
    for _ in range(MOST_ROUNDS):
        given = found.join(labels.withColumnRenamed("rank", "u_rank"), [*BUNDLE, "u_rank"]).groupBy(*BUNDLE, F.col("v_rank").alias("rank")).agg(F.min("least").alias("given"))
        jump = labels.select(*BUNDLE, F.col("rank").alias("near"), F.col("least").alias("jump"))
        near = labels.join(given, [*BUNDLE, "rank"], "left").select(*BUNDLE, "rank", "least", F.least("least", F.coalesce("given", "least")).alias("near"))
        new = near.join(jump, [*BUNDLE, "near"]).select(*BUNDLE, "rank", F.least("near", "jump").alias("new"), "least")
        new = stored(new, "umi-labels")
        labels = new.select(*BUNDLE, "rank", F.col("new").alias("least"))
        if new.where("new <> least").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
