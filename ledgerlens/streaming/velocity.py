"""Transaction velocity over streams: the batch features' counts as event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def velocity(transactions: DataFrame, window: str = "1 hour", late: str = "24 hours", key: str = "user_id", time: str = "ts", slide: str | None = None) -> DataFrame:
    """Transactions and amount per key and window; works on batch and streaming frames. State older than ``late`` is dropped."""
    rows = transactions.withWatermark(time, late) if transactions.isStreaming else transactions
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    counted = rows.groupBy(frame.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("amount"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n", "amount")


def first_seen(rows: DataFrame, key: str, time: str = "ts", late: str = "24 hours") -> DataFrame:
    """Each key's first record: the first that comes within the watermark on a stream, the earliest on a batch (of equal times the least by all columns)."""
    if rows.isStreaming:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    earliest = F.struct(F.col(time).isNull(), time, *sorted(c for c in rows.columns if c not in (key, time)))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), earliest).alias("_r")).select("_r.*")
