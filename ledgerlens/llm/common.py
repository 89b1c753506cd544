"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.batches import bounded as python_batches
from ledgerlens.functions.storage import discard, work_path

#: Rows of a table that may be broadcast; the operators count a table before they broadcast it and join by shuffle above it.
BROADCAST_ROWS = 500_000

#: Paths that ``saved`` has written while ``scratch`` is open, the innermost last.
OPEN: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The column as text; null is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def keyed(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """``columns`` and ``_text`` (null: empty), with ``_th``, a hash of the text.

    Rows are told apart by (doc_id, _th): repeated rows get the same result, rows that share only the id or have none get their own.
    """
    body = text_of(text)
    return docs.select(*columns, body.alias("_text"), F.xxhash64(body).alias("_th"))


def same_row(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Null-safe equality of ``keys``."""
    test = F.lit(True)
    for k in keys:
        test = test & a[k].eqNullSafe(b[k])
    return test


def covered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and the new names by the old ones."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def uncovered(rows: DataFrame, names: dict[str, str], **instead: Column) -> DataFrame:
    """The columns of ``docs`` back under their names, ``instead`` of some of them others."""
    return rows.select(*[instead.get(c, F.col(new)).alias(c) for c, new in names.items()])


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``saved`` writes inside is deleted at the end, when all that was made of it must have been written."""
    OPEN.append([])
    try:
        yield
    finally:
        for path in OPEN.pop():
            discard(spark, path)


def saved(df: DataFrame, name: str, shrink: int = 1) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors.

    Results of the operators read these tables lazily; within ``scratch`` they are deleted at its end, else they stay.
    ``shrink``: rows so light that the last stage needs only one in so many of the shuffle partitions, and as few files.
    """
    path = work_path(df.sparkSession, name)
    if OPEN:
        OPEN[-1].append(path)
    if shrink > 1:
        df = df.coalesce(max(1, partitions(df.sparkSession) // shrink))
    df.write.option("compression", "zstd").parquet(path)  # the default codec keeps direct memory until the heap is collected
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
