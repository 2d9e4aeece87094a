"""Breadth-first closure of a link graph by frontier DataFrames."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable


def frontier(links: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """node, depth of everything reached from the seeds, to ``limit`` rounds if given; links: src, dst. Each round shuffles the frontier, not the visited nodes' links."""
    visited = reliable(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = visited
    for depth in count(1) if limit is None else range(1, limit + 1):
        step = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        front = reliable(step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        visited = reliable(visited.unionByName(front))
    return visited
