"""Connected components of an edge table by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): the smallest node reachable.

    A round takes the smallest label among a node's neighbours and then the label of that label, so paths
    shorten by more than half; every round is a stored table. Labels are summed up by minimum before they
    are shuffled, so a node with very many neighbours costs each task one row. Null ends are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("best")).withColumnRenamed("a", "node")
        moved = labels.join(near, "node").select("node", F.least("label", "best").alias("next"), F.col("label").alias("was"))
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = stored(moved.join(far, F.col("next") == F.col("via"), "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "was"), "cc-labels")
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
