"""Connected components of a graph given as edges, as joins and sums; no component ever meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratusqc.session import write_and_reread


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node of its component.

    In each round a node and the node it points to take the smallest label across their edges, then every
    pointer is replaced by its pointer's. The number of rounds grows with the logarithm of the longest path.
    Loops, repeated edges and either direction are allowed.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = write_and_reread(both.filter("a is not null and b is not null").distinct(), "edges")
    labels = write_and_reread(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = labels.select(F.col("node").alias("a"), F.col("label").alias("own"))
        far = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        pairs = both.join(near, "a").join(far, "b").filter("other < own")
        told = pairs.select(F.explode(F.array("a", "own")).alias("node"), "other").groupBy("node").agg(F.min("other").alias("other"))
        told = write_and_reread(told, "told")
        if told.isEmpty():
            return labels
        hooked = labels.join(told, "node", "left").select("node", F.coalesce(F.least("label", "other"), "label").alias("label"))
        hooked = write_and_reread(hooked, "hooked")
        ahead = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = write_and_reread(hooked.join(ahead, "label").select("node", F.col("next").alias("label")), "labels")
