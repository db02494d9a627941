"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node of the edges (a, b); ids are longs.

    Each round takes the least label among neighbours, then the label's own label. Labels stay in the shared folder;
    only their sum reaches the driver. Equal edges and loops do no harm."""
    pairs = edges.select("a", "b").where("a <> b").distinct()
    both = materialize(pairs.union(pairs.select("b", "a")).toDF("src", "dst"))
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now is None or now == total:
            return labels
        total = now
        near = both.join(labels, both.src == labels.node).select(F.col("dst").alias("node"), "component")
        least = materialize(near.union(labels).groupBy("node").agg(F.min("component").alias("component")))
        up = least.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        jumped = materialize(least.join(up, "component").select("node", F.col("upper").alias("component")))
        release(least)
        release(labels)
        labels = jumped
