"""Distributed union-find: connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a hub with very many links is combined before the
shuffle and split by adaptive skew joins; no links, groups or labels are ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release


#: Rows up to which a table is broadcast to a join; its rows are counted first.
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame, rows: int) -> DataFrame:
    """``table`` with a broadcast hint while it has few rows; beyond that joins shuffle both sides."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node that has a link to another one; component is its smallest node.

    Links are undirected; those from a node to itself, with a null end, or repeated change nothing.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges, before = checkpointed(edges), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(small(least, 2 * now[0]), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small(least, 2 * now[0]), "a")
        stars = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", "m")).distinct()
        edges = checkpointed(stars)
        # every step has shuffle files, of many small blocks where there are many partitions
        del both, least, large, joined, stars
        release(links.sparkSession)
