"""Connected components of a link table, by star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs below one root that hangs below none."""
    seen = edges.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("a").alias("root")))
    per_node = seen.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                        F.max(F.col("root").isNull()).alias("is_root"))
    return per_node.where("low != high OR (low IS NOT NULL AND is_root)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the (a, b) links, where component is
    the smallest node reachable. Each round links every node to the smallest
    one known near it (large star, then small star) and is written to the
    shared folder; rounds grow with the logarithm of the nodes. A node with
    very many links is only ever aggregated (min) and joined."""
    edges = common.stage(edges.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    while not _settled(edges):
        # large star: neighbours above u hang below the smallest of u's neighbourhood
        near = _both_ways(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = near.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: all smaller neighbours of u, and u, hang below the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(
            F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x != y")
        before = edges
        edges = common.stage(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-links")
        common.discard(before)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
