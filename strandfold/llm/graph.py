"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.llm.shared import stored

MOST_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id in edges (a, b); ids without edges don't occur.

    Labels start as the smallest neighbour. A round takes the smallest label among the
    neighbours and the label's own label (pointer jumping), so paths shrink by doubling.
    Each round is one table in the shared folder; nothing is gathered but the number of
    changed rows. An empty table gives an empty result; null ends are dropped.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        own = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        new = labels.join(near, "id").join(own, "label").select("id", F.least("label", "near", "jump").alias("new"), "label")
        new = stored(new, "labels")
        labels = new.select("id", F.col("new").alias("label"))
        if new.where("new <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
