"""Reachability over stored links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barproof.sources.readers import stored


def reach(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes reached from the seeds with their depth: one join per level, only new nodes go on, until no node is new."""
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    seen = stored(seen, "reach")
    edge, depth = seen, 0
    while not edge.isEmpty():
        depth += 1
        new = edge.join(links, edge.node == links.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        edge = stored(new.withColumn("depth", F.lit(depth)), "reach")
        seen = seen.unionByName(edge)
    return seen
