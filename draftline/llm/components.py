"""Connected components of a graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import store


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, component: the smallest node it can reach, for every node of an edge (bigint, not NULL).

    Large star and small star in turn until nothing changes; rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder. A hub is one row in the table of
    minima; its edges are the split side of a join, never a collected group.
    """
    pair = edges.where(F.col(left) != F.col(right))
    current = store(pair.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct(), "edges")
    state = None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = store(large.distinct(), "large-star")
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(roots, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(roots.select("a", F.col("m").alias("b"))).distinct()
        current = store(small, "small-star")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
