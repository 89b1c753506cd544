"""Document order without a global sort: range buckets with each bucket's successor row added to it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, small

#: Bytes of text that a bucket holds about.
BUCKET_BYTES = 32 << 20
#: Cuts that a plan holds at most; with more buckets each range is cut again by a table of its cuts.
MOST_CUTS = 1024


def cut_points(ids: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets`` - 1 values that split ``column`` into ranges of about equal counts."""
    if buckets < 2:
        return []
    found = ids.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0]
    return sorted(set(found or []))


def bucket_of(column: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` are at or below the value (0 for null), found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c <= column))
    heads = F.array(*[F.lit(g[0]) for g in groups])
    parts = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    group = below(heads) - 1
    return F.when(column.isNull() | (group < 0), 0).otherwise(group * step + below(F.get(parts, group)))


def ranged(rows: DataFrame, column: str, buckets: int) -> tuple[DataFrame, int]:
    """``rows`` with _bucket, the number of their range of ``column`` (null in the first), and how many there are; the plan's size doesn't follow ``buckets``."""
    if buckets <= MOST_CUTS:
        cuts = cut_points(rows.select(column), column, buckets)
        return rows.withColumn("_bucket", bucket_of(F.col(column), cuts)), len(cuts) + 1
    top = cut_points(rows.select(column), column, MOST_CUTS)
    inner = -(-buckets // (len(top) + 1))
    within = F.percentile_approx(column, [i / inner for i in range(1, inner)], 100 * inner)
    fine = rows.select(column, bucket_of(F.col(column), top).alias("_c")).groupBy("_c").agg(F.sort_array(F.array_distinct(F.coalesce(within, F.array()))).alias("_cuts"))
    before = F.coalesce(F.sum(F.size("_cuts") + 1).over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # MOST_CUTS rows at most
    fine = saved(fine.withColumn("_before", before.cast("int")), "cuts", shrink=partitions(rows.sparkSession))
    total = fine.agg(F.max(F.col("_before") + F.size("_cuts") + 1)).first()[0] or 1
    joined = rows.withColumn("_c", bucket_of(F.col(column), top)).join(F.broadcast(fine), "_c", "left")
    place = F.col("_before") + F.when(F.col(column).isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col(column))))
    return joined.withColumn("_bucket", place).drop("_c", "_cuts", "_before"), total


def with_successors(rows: DataFrame, order: list[str], text: str) -> DataFrame:
    """``rows`` with _bucket, a partition each, and _ghost.

    Buckets are ranges of the first column of ``order``, nulls first, of about ``BUCKET_BYTES`` of ``text`` (as many as shuffle partitions at least). To each bucket comes a ghost: a copy of the first row of
    the next bucket (of the first bucket, for the last one), so that every row finds its successor within its bucket, after all
    others by (_ghost, *order). What is known of a bucket, its first id and hash, is a row of a table.
    """
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(partitions(rows.sparkSession), size // BUCKET_BYTES)
    rows, total = ranged(rows, order[0], buckets)
    firsts = saved(rows.groupBy("_bucket").agg(F.min(F.struct(*order)).alias("_first")), "firsts", shrink=8)
    n, last = firsts.agg(F.count("*"), F.max("_bucket")).first()
    if not n:
        return rows.withColumn("_ghost", F.lit(False))
    before = F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.lit(last))  # a row per bucket
    table = firsts.select(*[F.col(f"_first.{c}").alias(f"_f{i}") for i, c in enumerate(order)], before.alias("_target"))
    same = F.lit(True)
    for i, c in enumerate(order):
        same = same & rows[c].eqNullSafe(table[f"_f{i}"])
    ghosts = rows.join(small(table, n), same).select(*[rows[c] for c in rows.columns if c != "_bucket"], F.col("_target").alias("_bucket"), F.lit(True).alias("_ghost"))
    return rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts).repartitionById(total, F.col("_bucket").cast("int"))
