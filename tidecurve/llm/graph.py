"""Connected components by alternating stars (Kiveris and others, 2014), in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecurve.llm.common import fits, released, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) of every node that has a link to another node.

    Nulls link nothing. Each round writes its edges in the shared folder; rounds grow with the logarithm of the longest path, and
    none is run only to see that nothing changes: all is told once no node with a smaller neighbour has another one. Minima
    are aggregated before the shuffle, so a node of very many links is no hot group. The nodes' minima are broadcast if those of all
    edges fit, so that a round shuffles them alone, and the edges not at all; else they are written and joined."""
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    while True:
        few = fits(edges, 4)  # two nodes for each edge, and both minima in memory
        shared = (lambda df, name: F.broadcast(df)) if few else written
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
        nearest = nearest if few else written(nearest, "nearest")
        if nearest.where("low < n and low <> high").agg(F.count("*")).first()[0] == 0:
            return nearest.select(F.col("n").alias("node"), F.least("n", "low").alias("component"))
        least = nearest.select("n", F.least("n", "low").alias("m"))
        large = edges.join(F.broadcast(least) if few else least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))
        large = large if few else written(large.distinct(), "edges")
        low = shared(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "lowest")
        # A node's least neighbour takes the node itself, the others go to the least one.
        star = large.join(low, F.col("u") == F.col("n")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(star if few else star.distinct(), "edges")
        released(last, *([] if few else [nearest, large, low]))
