"""Walks over a graph of claims: what can be reached within a few hops, by which shortest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecurve.operators.tables import settled

HOPS = 3


def walks(edges: DataFrame, starts: DataFrame, hops: int = HOPS) -> DataFrame:
    """start, node, hops, path of each node that a start reaches in 1 to `hops` steps, by the smallest of its shortest paths.

    edges: source, target. starts: start. A hop joins the frontier with the edges and leaves out what is reached already (cycles,
    and nodes of longer paths); of paths to one node the smallest is kept before the next hop, so rows follow what is reached, not
    the number of paths. Each hop is written, so plans don't grow. Null ends are no edges."""
    edges = edges.where("source is not null and target is not null").select("source", "target").distinct()
    edges = settled(edges)
    frontier = settled(starts.where("start is not null").select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct())
    seen = frontier
    for _ in range(hops):
        step = frontier.join(edges, F.col("node") == F.col("source")).select("start", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = settled(step.groupBy("start", "node").agg(F.min("path").alias("path")))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen.where(F.size("path") > 1).select("start", "node", (F.size("path") - 1).alias("hops"), "path")
