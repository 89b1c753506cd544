"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is joins and partial aggregates over edges,
written to the shared folder; no list of neighbours is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SALTS = 16


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _told(near.where(F.col("b") > F.col("a")), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _told(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (a, b) with m of ``least`` (a, m). The centre of a large star has its rows dealt to ``SALTS`` places, to each of which its m is sent; by shuffle at any size, as a broadcast would be chosen by the size before that."""
    salted = least.select("a", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    return rows.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["a", "_s"]).select("a", "b", "m")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = _told(down, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; a root is the least node of its component."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", shrink=8)
    before = mark(now)
    while before[0]:
        now = saved(_small_star(_large_star(now)), "edges", shrink=8)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
