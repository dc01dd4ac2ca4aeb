"""Connected components by repeated joins, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import drop_table, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node of its component.

    Each round takes the least label among a node and its neighbours, then the
    label's own label; every round's table is written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = materialize(least.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")), "labels")
        drop_table(edges.sparkSession, labels)
        labels = new.select("node", "label")
        if not new.where(F.col("old") != F.col("label")).take(1):
            drop_table(edges.sparkSession, both)
            return labels
