"""Connected components of a graph of any size, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the smallest node reachable.

    Each turn takes the smallest label among neighbours and then the label of that
    label, so long paths shorten fast; each turn is written, so a lost executor
    costs no earlier turn. Neighbours are reduced, never gathered.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near")))
        lower = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        # every label is a node, so this join finds a row for each
        turned = materialize(lower.join(up, "low").select(
            "node", F.least("low", "top").alias("new"), (F.least("low", "top") < F.col("label")).alias("moved")), "labels")
        labels = turned.select("node", F.col("new").alias("label"))
        if turned.where("moved").isEmpty():
            return labels
