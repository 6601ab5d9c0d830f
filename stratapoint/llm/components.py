"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up at most, and those that have one have none down: then all edges lead to roots."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = edges.select(F.explode(ends).alias("e")).groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return seen.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b: long) -> (node, root) for every node of an edge; root is the component's least node.

    Each round replaces a node's edges by edges to its least neighbour and is
    written to the shared folder; the rounds end when all that is left are stars. A node with
    very many edges is met by partial aggregates and by joins that Spark can
    split. Only the written table of a round is
    made distinct: what a round repeats in between does no harm to the least neighbours.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # the least neighbour itself, and an edge from every other neighbour to it
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v")
        after = scratch.save(small.filter("u > v").distinct())
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
