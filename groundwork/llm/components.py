"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Scratch


def components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); a component's label is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label's own label,
    so a path shortens by more than half. Rounds are written tables; the driver sees two counts."""
    both = tmp.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = tmp.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        nxt = step.join(up, "low", "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("jump", "low")).alias("label"))
        nxt = tmp.write(nxt, "labels")
        tmp.drop(labels)
        labels = nxt
        if nxt.where(F.col("old") != F.col("label")).isEmpty():
            tmp.drop(both)
            return labels.select("node", "label")
