"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the least node of its component.

    Nodes are of any type with an order, structs too: naming them by what the least
    one shall tell saves a join of all members with their root.
    Each round links every node's larger neighbours to its least one (large
    star), then its smaller ones (small star).  It ends when the links are stars around the roots: no node has two links to smaller ones, and
    none has both a smaller and a larger one.  That takes rounds that grow with the logarithm of the number of nodes squared at
    most, and fewer where the links are nearly stars, as those of an earlier call are.  Only one number of a round comes to the driver.
    """
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not stars(edges):
        both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("w"), F.col("v").alias("x")), F.struct(F.col("v").alias("w"), F.col("u").alias("x")))).alias("e")).select("e.*")
        least = both.groupBy("w").agg(F.min("x").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = edges.join(least, F.col("v") == F.col("w")).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = settled(small.select("e.u", "e.v").where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges (u, v), v < u, has one smaller neighbour, or larger ones only."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("w"), F.lit(1).alias("below")), F.struct(F.col("v").alias("w"), F.lit(0).alias("below")))).alias("e")).select("e.*")
    mixed = ends.groupBy("w").agg(F.sum("below").alias("below"), F.min("below").alias("least")).where("below > 1 or (below = 1 and least = 0)")
    return mixed.agg(F.count(F.lit(1))).first()[0] == 0
