"""Connected components by minimum labels and pointer jumping, as joins over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, write_shared


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b long) -> (node, label): label is the smallest node that can be reached. Nodes without an edge are absent."""
    both = write_shared(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = write_shared(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    state = None
    while True:
        now = labels.agg(F.count("*").alias("n"), F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            drop_shared(both)
            return labels
        state = now
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, labels.node == near.a, "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"))
        least = write_shared(least, "labels")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("up"))
        before, labels = labels, write_shared(least.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        drop_shared(before, least)
