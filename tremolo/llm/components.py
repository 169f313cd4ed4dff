"""Connected components of an edge table by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of ``edges`` (u long, v long); label: one node of its component.

    Each round every node takes the least of its neighbours and itself, and the edges are rewritten to
    those labels.  Ids should be hashes: then each round leaves at most about half of the nodes.
    """
    left = scratch.table(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while True:
        both = left.union(left.select("v", "u"))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        if labels is None:
            labels = least.select(F.col("u").alias("node"), F.col("m").alias("label"))
        else:
            moved = labels.join(least, F.col("label") == F.col("u"), "left")
            labels = moved.select("node", F.coalesce("m", "label").alias("label"))
        labels = scratch.table(labels)
        a = least.select("u", F.col("m").alias("a"))
        b = least.select(F.col("u").alias("v"), F.col("m").alias("b"))
        left = left.join(a, "u").join(b, "v").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        left = scratch.table(left)
        if left.isEmpty():
            return labels
