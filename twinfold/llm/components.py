"""Connected components of an edge table by alternating large-star and small-star steps, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edge table (u, v) with its component's least node.

    A step rewrites edges so that nodes point to ever smaller ones; the number of steps grows with the logarithm
    of the longest path. Each step's table goes to the shared folder. No edges give no rows."""
    current = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    known = _digest(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: greater neighbours of u point to the least node near u.
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large")
        # Small star: u and its smaller neighbours point to the least of them.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = stored(small, "edges")
        found = _digest(small)
        if found == known:
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        current, known = small, found


def _digest(edges: DataFrame) -> tuple:
    """The count of a table of distinct edges and the sum of their hashes, which tell whether a step changed it."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
