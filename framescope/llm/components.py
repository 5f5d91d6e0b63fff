"""Connected components of a large sparse graph by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) of every node with an edge.

    Every round a node takes the smallest label among itself and its neighbours,
    then its label's label, so the number of rounds follows the logarithm of the
    longest path.  Every round's labels are checkpointed.  Minima are combined
    before each shuffle; a hot node's edges are dealt out by the skew join.
    """
    both = edges.select(F.col(left).alias("node"), F.col(right).alias("other"))
    both = checkpointed(both.union(both.select(F.col("other"), F.col("node"))).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        joined = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("above"))
        after = checkpointed(joined.join(up, "new").select("node", F.least("new", "above").alias("label"), "old"))
        labels = after.select("node", "label")
        if after.filter(F.col("label") != F.col("old")).isEmpty():
            return labels
