"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _is_stars(edges: DataFrame) -> bool:
    """Whether no node of distinct edges (v, u) has several of them or is another's u."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """From undirected edges (a, b) to (node, component), the least node reachable.

    Every step is a minimum per node (combined before the shuffle) and a join, so
    no neighbour list is gathered. Self loops and repeated edges are harmless. It ends as
    soon as every node is either a root or has one edge, to a root.
    """
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    e = materialize(e)
    while not _is_stars(e):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.unionByName(least.where("m < v").withColumnRenamed("m", "u")).distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = small.unionByName(lowest.withColumnRenamed("m", "u")).distinct()
        old, e = e, materialize(small)
        discard(old)
    nodes = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = e.select(F.col("u").alias("node")).distinct()
    roots = roots.join(e.select(F.col("v").alias("node")), "node", "left_anti")
    return nodes.unionByName(roots.withColumn("component", F.col("node")))
