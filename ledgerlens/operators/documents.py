"""Document analysis: pattern counts, compliance band, statistics, masks and page spans as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import text as t


def signals(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, counts): how often each financial and compliance pattern occurs."""
    return docs.select(key, *[t.pattern_count(F.col(text), name).cast("int").alias(name) for name in t.PATTERNS])


def compliance_band(accounts: Column, pans: Column) -> Column:
    return F.when((accounts > 5) | (pans > 3), "high").when((accounts > 0) | (pans > 0), "medium").otherwise("low")


def statistics(docs: DataFrame, key: str = "document_id", text: str = "text", pages: Column | None = None) -> DataFrame:
    """(key, word_count, char_count, line_count, words_per_page); a null text is empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = t.word_count(body)
    return docs.select(key, words.cast("long").alias("word_count"), F.length(body).cast("long").alias("char_count"), t.line_count(body).cast("long").alias("line_count"), (words / F.greatest(pages if pages is not None else F.lit(1), F.lit(1))).alias("words_per_page"))


def page_spans(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, page_number, first, past): the characters of each page in the document, from (key, page_number, text)."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.select(key, "page_number", before.alias("first"), (before + F.length("text")).alias("past"))


def page_of(positions: DataFrame, spans: DataFrame, key: str = "document_id") -> DataFrame:
    """``positions`` (key, position, ...) with page_number: a range join within the document; null outside all pages.

    The span that holds a position is the last that begins at or before it, so that one sorted pass over both replaces the comparison of
    every position with every page.
    """
    rest = [c for c in positions.columns if c not in (key, "position")]
    marks = spans.select(key, F.col("first").alias("position"), F.lit(0).alias("_kind"), F.struct("page_number", "past").alias("_span"))
    both = marks.unionByName(positions.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("position", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_span", F.last("_span", ignorenulls=True).over(order)).where("_kind = 1")
    return both.select(key, "position", *rest, F.when(F.col("position") < F.col("_span.past"), F.col("_span.page_number")).alias("page_number"))
