"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node that links reach.

    Each round joins every node with the smallest of its neighbours; nothing but edge counts
    reaches the driver and no neighbour list is gathered. A node may have any number of edges.
    """
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    e = staged(edges.where("a != b").select(hi, lo).distinct())
    seen = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        # Large star: neighbours above a node are linked to the smallest neighbour (or the node).
        # The minima are written, so that the join shuffles both its sides and a node with very
        # many neighbours can be split.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours are linked to the smallest of them. After
        # the large star a node has few smaller neighbours, one for each smallest it was given.
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        up = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(up.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
