"""Chunks, vector search, reranking and retrieval metrics over many documents and queries at once."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.batches import bounded
from ledgerlens.functions.text import blank_words, section_title

# Keywords and weights that the rerank score is defined by.
FINANCIAL = [
    "revenue", "profit", "loss", "cash flow", "ebitda", "margin", "risk", "exposure", "volatility", "debt", "equity", "return", "interest rate", "inflation", "gdp",
    "index", "fund", "portfolio", "dividend", "yield", "credit", "default", "rating", "compliance", "regulation", "requirement", "reserve", "capital", "roe", "roa",
]
BOILERPLATE = ["all trademarks", "copyright", "disclaimer", "confidential", "footnote", "page break", "table of contents", "index", "header", "footer", "page number"]
PARAGRAPH, SENTENCE = re.compile(r"\n\n+"), re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
PAGE_CHARS = 3000
CHARS_PER_TOKEN = 4


def pieces(text: str, parts: re.Pattern) -> Iterator[tuple[int, str]]:
    """What stands between matches of ``parts``, with where it begins; blank pieces are left out."""
    at = 0
    for m in parts.finditer(text):
        if text[at : m.start()].strip():
            yield at, text[at : m.start()]
        at = m.end()
    if text[at:].strip():
        yield at, text[at:]


def packed(found: Iterator[tuple[int, str]], joiner: str, budget: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pieces put together while their length, without joiners in the test, stays within the budget; and where each piece begins, in what is made and in the text."""
    now, places = "", []
    for at, piece in found:
        if now and len(now) + len(piece) > budget:
            yield now, places
            now, places = "", []
        now = now + joiner if now else ""
        places.append((len(now), at))
        now += piece
    if now:
        yield now, places


def pieced(text: str, budget: int) -> Iterator[tuple[str, int]]:
    """The chunks of a text, and where the first piece of each begins: packed paragraphs, and packed sentences where those are too long."""
    for whole, places in packed(pieces(text, PARAGRAPH), "\n\n", budget):
        if len(whole) <= budget:
            yield whole, places[0][1]
            continue
        for part, inner in packed(pieces(whole, SENTENCE), " ", budget):
            first = inner[0][1]
            begin, at = places[bisect_right(places, (first, len(text))) - 1]
            yield part, at + first - begin


def tail(text: str, size: int, mode: str) -> str:
    """The end of a text before the overlap: mode "last_word" keeps what follows the last blank, "budget" whole words within ``size``."""
    if len(text) <= size:
        return text
    end = text[-size:]
    if mode == "budget":
        return end.partition(" ")[2] or end
    at = end.rfind(" ")
    return end[at:] if at > 0 else end


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 200, overlap_mode: str = "last_word", key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, chunk_id, position, page_number, page_by_offset, section_title, content, word_count, char_count), in chunks of about ``size`` tokens.

    Paragraphs are packed to the budget, longer ones by sentences, and each chunk begins with the end of the one before. page_number is that
    of the chunk's text in the document, null if it doesn't stand there as it is; page_by_offset that of where its first piece, after the overlap,
    begins. Packing is a fold over a document, so that it runs in Python, batch by batch; texts don't move.
    """
    budget, kept = size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, position, content, page, offset = [], [], [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                body, before = body or "", ""
                for i, (c, at) in enumerate(pieced(body, budget)):
                    whole = c if i == 0 else tail(before, kept, overlap_mode) + "\n\n" + c
                    found = body.find(whole)
                    owner.append(row)
                    position.append(i)
                    content.append(whole)
                    page.append(None if found < 0 else found // PAGE_CHARS + 1)
                    offset.append(at // PAGE_CHARS + 1)
                    before = c
            keys = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(position, pa.int32()), pa.array(content, pa.string()), pa.array(page, pa.int32()), pa.array(offset, pa.int32())], ["k", "position", "content", "page_number", "page_by_offset"])

    bounded(docs.sparkSession)
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    found = rows.mapInArrow(run, "k string, position int, content string, page_number int, page_by_offset int").where(F.btrim("content") != "")
    return found.select(
        F.col("k").alias(key), F.format_string("%s_chunk_%04d", "k", "position").alias("chunk_id"), "position", "page_number", "page_by_offset", section_title(F.col("content")).alias("section_title"), "content",
        blank_words(F.col("content")).alias("word_count"), F.length("content").alias("char_count"),
    )


def chunk_statistics(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"), F.sum("word_count").alias("words"), F.avg("char_count").alias("mean_chars"))


def unit(v: Column) -> Column:
    """The vector over its length, a little more than which it is divided by, so that zero vectors stay."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + 1e-10
    return F.transform(v, lambda x: x.cast("double") / norm)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def search(queries: DataFrame, vectors: DataFrame, k: int, key: str = "document_id", limit: int = 10_000) -> DataFrame:
    """The k nearest vectors of the same document for each query: (query_id, chunk_id, similarity, vector_rank).

    ``queries``: query_id, key, q; ``vectors``: key, chunk_id, v. Queries are a stated set; their number is checked before they are
    broadcast, and beyond ``limit`` both sides are joined by document. Ranks are taken per query within each partition by a window limit
    that Spark pushes before the shuffle.
    """
    asked = queries.select("query_id", key, unit(F.col("q")).alias("q"))
    asked = F.broadcast(asked) if queries.count() <= limit else asked
    near = vectors.select(key, "chunk_id", unit(F.col("v")).alias("v")).join(asked, key).select("query_id", "chunk_id", squared_distance(F.col("v"), F.col("q")).alias("d"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "chunk_id"))
    return near.withColumn("vector_rank", rank).where(F.col("vector_rank") <= k).select("query_id", "chunk_id", similarity(F.col("d")).alias("similarity"), "vector_rank")


def above_threshold(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits at or above the threshold; all hits of a query that has none."""
    passes = F.col("similarity") >= threshold
    any_pass = F.max(passes).over(Window.partitionBy("query_id"))
    return hits.withColumn("_any", any_pass).where(passes | ~F.col("_any")).drop("_any")


def rerank_score(content: Column, title: Column, query: Column) -> Column:
    low = F.lower(content)
    found = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    score = 0.5 + F.least(found(FINANCIAL) * 0.05, F.lit(0.2)) - F.least(found(BOILERPLATE) * 0.1, F.lit(0.3))
    score = score + F.when(F.contains(F.lower(title), F.lower(query)), 0.15).otherwise(0.0)
    score = F.when(blank_words(content) < 20, score * 0.8).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))


def rerank(hits: DataFrame, k: int = 5) -> DataFrame:
    """The k best of (query_id, similarity, vector_rank, content, section_title, query): rerank_score, final_score, confidence, rank."""
    scored = hits.withColumn("rerank_score", rerank_score(F.col("content"), F.col("section_title"), F.col("query")))
    scored = scored.withColumn("final_score", 0.7 * F.col("similarity") + 0.3 * F.col("rerank_score")).withColumn("confidence", F.least(F.col("final_score") * 1.5, F.lit(1.0)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "vector_rank"))).where(F.col("rank") <= k)


def relevance(content: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(F.lower(content), F.lower(k)))


def ranking_metrics(ranked: DataFrame) -> DataFrame:
    """(query_id, mrr, ndcg, ndcg_log2, precision) from (query_id, rank, relevant): ndcg discounts by the root of the rank, all relevant being ideal."""
    gain = F.when(F.col("relevant"), 1.0).otherwise(0.0)
    root, log = F.sqrt("rank"), F.log2(F.col("rank") + 1)
    a = ranked.groupBy("query_id").agg(
        F.coalesce(1 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        (F.sum(gain / root) / F.sum(1 / root)).alias("ndcg"), (F.sum(gain / log) / F.sum(1 / log)).alias("ndcg_log2"), F.avg(gain).alias("precision"),
    )
    return a


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors, by chunk_id and never by position; chunks without one have null."""
    return chunks.join(vectors.select("chunk_id", "vector"), "chunk_id", "left")


def with_content(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits of a search with the chunks they name."""
    return hits.join(chunks, "chunk_id")


def embed(dims: int = 384):
    """A pandas UDF text -> array<float>: counts of lower-cased words, dealt and signed by their MD5, the stand-in where no model is at hand."""
    import hashlib

    import numpy as np

    @F.pandas_udf("array<float>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for batch in texts:
            out = []
            if len(known) > 500_000:
                known.clear()
            for text in batch:
                v = np.zeros(dims, np.float32)
                for word in (text or "").lower().split():
                    h = known.get(word)
                    if h is None:
                        h = known[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                    v[h % dims] += 1 if h & 0x80000000 else -1
                out.append(v)
            yield pd.Series(out)

    return vectors


def embed_missing(texts: DataFrame, cache: DataFrame, embedder, model: str = "hashed", force_refresh: bool = False, text: str = "content", key: str = "document_id") -> DataFrame:
    """(key, model, md5, vector, cached) of all distinct texts of each document: those in ``cache`` (key, model, md5, vector) as they are, the rest computed.

    With ``force_refresh`` all are computed. A text is embedded once, however many documents hold it.
    """
    by = [key, "model", "md5"]
    named = texts.select(key, F.lit(model).alias("model"), F.md5(text).alias("md5"), F.col(text).alias("_text")).dropDuplicates(by)
    new = named if force_refresh else named.join(cache.select(*by), by, "left_anti")
    made = new.select("md5", "_text").dropDuplicates(["md5"]).select("md5", embedder(F.col("_text")).alias("vector"))
    fresh = new.select(*by).join(made, "md5").select(*by, "vector", F.lit(False).alias("cached"))
    if force_refresh:
        return fresh
    return cache.join(named.select(*by), by, "left_semi").select(*by, "vector", F.lit(True).alias("cached")).unionByName(fresh)
