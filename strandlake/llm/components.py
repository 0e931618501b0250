"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import drop, table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Of distinct edges with u > v: whether every node has one edge down, or only edges up. Then each component is a star around its smallest node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.down").alias("down"), F.count("*").alias("all")).where("down > 0 and all > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: columns u, v (bigint). Returns node, component (its smallest node) for every node that has a link.

    The number of rounds grows with the logarithm of the longest chain; links that are stars already need none. Only whether one more
    is needed comes to the driver. Self links, repeated links and either direction may occur; nulls are dropped; an empty table gives an
    empty result.
    """
    edges = table(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _only_stars(edges):
        new = table(_small_star(_large_star(edges)), "stars")
        drop(edges)
        edges = new
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
