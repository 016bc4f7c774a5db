"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, by partial sums, and then the label
    of that label. Joins have one row for each key on one side, so a node of very many edges can be split.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    if labels.isEmpty():
        return labels.select("node", F.col("label").alias("component"))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(nearer.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")))
        if new.where("label <> was").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
