"""Substring deduplication by sliding sentence spans.

A text is cut into words at ASCII white space and into sentences at line ends and after words that end in . ! or ?; a sentence of
more than ``UNIT_WORDS`` words counts as several. Every run of ``RUN`` consecutive sentences (all sentences, in a shorter text),
and of as many more as it takes to have ``MIN_WORDS`` words, is hashed to 95 bits over its lower-cased words. Of the places of a
hash over all documents the first, by doc_id, text hash and position, stays; sentences covered by any other place are removed, with the white
space before them.

Sentences are cut from where they begin, so that a passage that begins inside one may share no run with its other places. What
runs leave is therefore searched word by word: of ``PASSAGE`` consecutive words that stay whole, all places but the first are removed
too. Candidates are windows' least hashes of ``GRAM`` words, one of which any two equal passages share; they are compared as
whole windows only where a candidate is repeated and kept.

Runs and candidates come from one pass over the texts, as rows of fixed size: a place and a hash. The search for firsts is a partial
hash aggregate of documents' ranks, saved before it is joined back, so that adaptive execution can split the join of a very common run. Texts
are joined again only for documents that hold a kept candidate, and to be cut.

Edge cases: null texts stay null and have no sentences; empty texts and texts of white space stay; white space at the end belongs to the last
sentence; rows that share id and text are one document and keep what it keeps; texts that share an id, or have none, are documents of
their own, in the order of their hashes; null ids come first; ids must be integers; texts of any length are cut whole; other columns come back as they were whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import covered, keyed, python_batches, saved, small, table, text_of

UNIT_WORDS = 16
RUN = 3
MIN_WORDS = 8

#: Words of a repeated passage that is found wherever it begins, and of the pieces by which it is looked for.
PASSAGE = 51
GRAM = 16

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: What the hash of a sentence's first word differs by in the hash of a run.
OPENS = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, n of them."""
    known = POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        POWERS[base] = known = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
    return known[:n]


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's bytes begin and end."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~SPACE[raw]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def openings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = UNIT_WORDS) -> np.ndarray:
    """Which words begin a sentence."""
    n = len(starts)
    first = np.ones(n, bool)
    if n > 1:
        lines = np.concatenate([np.zeros(1, np.int64), np.cumsum(raw == 10)])
        first[1:] = STOP[raw[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    place = np.arange(n)
    return first | ((place - np.maximum.accumulate(np.where(first, place, 0))) % most == 0)


def parsed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a text, in lower case, and which words begin a sentence."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    starts, ends = bounds(raw)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, bool)
    size = ends - starts
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    letters = raw[within + np.repeat(starts, size)]
    hashes = np.add.reduceat(BYTES[letters] * powers(BASES[0], int(size.max()))[within], np.cumsum(size) - size)
    return mixed(hashes), openings(raw, starts, ends)


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of the words of each span."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, len(words)))])
    return mixed((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(words) + 1)[start])


def window_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    start = np.arange(max(0, len(words) - n + 1))
    return span_hashes(words, start, start + n, base)


def runs(words: np.ndarray, opens: np.ndarray, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and two hashes of every run of ``run`` sentences, and of as many more as it takes to have ``min_words`` words."""
    edge = np.append(np.flatnonzero(opens), len(words))
    n = len(edge) - 1
    first = np.arange(max(0, n - run) + 1 if n else 0)
    last = np.maximum(np.minimum(first + run, n), np.searchsorted(edge, edge[first] + min_words))
    first, last = first[last <= n], last[last <= n]
    start, end = edge[first], edge[last]
    marked = words + np.where(opens, OPENS, np.uint64(0))
    return start, end, span_hashes(marked, start, end, BASES[0]), span_hashes(marked, start, end, BASES[1])


def chosen(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of pieces of GRAM words: the first least one of each PASSAGE words, so that equal passages choose alike."""
    grams = window_hashes(words, GRAM, BASES[0])
    wide = PASSAGE - GRAM + 1
    if len(grams) < wide:
        return np.empty(0, np.int64), grams[:0]
    at = np.unique(np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(len(grams) - wide + 1))
    return at, grams[at]


def as_long(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64))


def as_int(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int32))


MARK_RUN, MARK_PIECE = 0, 1


def opening(hashes: np.ndarray) -> np.ndarray:
    """Which of a document's hashes have no equal one before them."""
    out = np.zeros(len(hashes), bool)
    out[np.unique(hashes, return_index=True)[1]] = True
    return out


def marks(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, _th, kind, _at, _end, _h1, _h2, _opens): all runs and all chosen pieces of every document, in words; _opens: the first of its hash in the document."""
    python_batches(docs.sparkSession)
    rows = keyed(docs, "doc_id").select("doc_id", "_th", "_text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, kinds, at, end, one, two, opens_ = [], [], [], [], [], [], [np.empty(0, bool)]
            with np.errstate(over="ignore"):
                for i, text in enumerate(batch.column(2).to_pylist()):
                    words, opens = parsed(text)
                    start, stop, h1, h2 = runs(words, opens, run, min_words)
                    place, h = chosen(words)
                    owner.append(np.full(len(start) + len(place), i))
                    kinds += [np.full(len(start), MARK_RUN), np.full(len(place), MARK_PIECE)]
                    at += [start, place]
                    end += [stop, place + GRAM]
                    one += [h1, h]
                    two += [h2 >> np.uint64(33), np.zeros(len(h), np.uint64)]
                    opens_ += [opening(h1), opening(h)]
            row = as_int(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), as_int(kinds), as_int(at), as_int(end), as_long(one), as_int(two), pa.array(np.concatenate(opens_))], ["doc_id", "_th", "kind", "_at", "_end", "_h1", "_h2", "_opens"])

    return rows.mapInArrow(made, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _th bigint, kind int, _at int, _end int, _h1 bigint, _h2 int, _opens boolean")


def order_of(doc: Column) -> Column:
    """doc_id as a number, null before all others."""
    return F.coalesce(doc.cast("long"), F.lit(-(2**63)))


def rank() -> Column:
    """doc_id and 32 bits of the text's hash as one number that a hash aggregate can take the minimum of."""
    low = F.col("_th").bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(10,0)")
    return (order_of(F.col("doc_id")).cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(30,0)")


def place() -> Column:
    """A document's rank and a position as one number."""
    return (rank().cast("decimal(29,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("_at").cast("decimal(10,0)")).cast("decimal(38,0)")


def later_places(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, _th, _at, _end, _h1) of the rows of ``marks`` whose hash has a place before theirs.

    A document's own repeats are known from the pass over it. Of its other marks those are later whose hash a document of lesser rank has: one
    number is all that the aggregate keeps. Its result grows with the rows, so that it is joined by shuffle at any size.
    """
    names = ["doc_id", "_th", "_at", "_end", "_h1"]
    first = rows.where("_opens").select(*names, "_h2")
    least = first.groupBy("_h1", "_h2").agg(F.min(rank()).alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = first.join(saved(least, name, shrink=4).hint("merge"), ["_h1", "_h2"]).where(rank() > F.col("_least"))
    return again.select(*names).unionByName(rows.where(~F.col("_opens")).select(*names))


def stretches(later: DataFrame) -> DataFrame:
    """(doc_id, _th, _start, _end): the union of (doc_id, _th, _at, _end) as disjoint stretches."""
    order = Window.partitionBy("doc_id", "_th").orderBy("_at", "_end")
    later = later.repartition("doc_id", "_th").withColumn("_edge", F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("_group", F.sum(F.when(F.col("_at") <= F.col("_edge"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return later.groupBy("doc_id", "_th", "_group").agg(F.min("_at").alias("_start"), F.max("_end").alias("_end")).drop("_group")


def per_document(cuts: DataFrame, name: str) -> DataFrame:
    """(_id, _own, ``name``): the stretches of each document that has any, in order."""
    return cuts.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_own")).agg(F.sort_array(F.collect_list(F.struct("_start", "_end"))).alias(name))


def of_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_own"])


def inside(cuts: list[dict] | None, n: int) -> np.ndarray:
    """Which of n words are in one of ``cuts``."""
    out = np.zeros(n, bool)
    for c in () if cuts is None else cuts:
        out[c["_start"] : c["_end"]] = True
    return out


def windows(rows: DataFrame) -> DataFrame:
    """(doc_id, _th, _at, _end, _kept, _h1, _h2): the windows of PASSAGE words around the pieces at ``_ats``; _kept: no word is in ``_cuts``."""
    python_batches(rows.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, places, kept, one, two = [], [], [np.empty(0, bool)], [], []
            with np.errstate(over="ignore"):
                for i, (text, cuts, ats) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 5)), strict=True)):
                    words, _ = parsed(text)
                    near = np.zeros(len(words) - PASSAGE + 1, bool)
                    for a in ats:
                        near[max(0, a + GRAM - PASSAGE) : a + 1] = True
                    at = np.flatnonzero(near)
                    lost = np.concatenate([[0], np.cumsum(inside(cuts, len(words)))])
                    owner.append(np.full(len(at), i))
                    places.append(at)
                    kept.append(lost[at + PASSAGE] == lost[at])
                    one.append(span_hashes(words, at, at + PASSAGE, BASES[0]))
                    two.append(span_hashes(words, at, at + PASSAGE, BASES[1]))
            row, at = as_int(owner), np.concatenate([np.empty(0, np.int64), *places])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), as_int([at]), as_int([at + PASSAGE]), pa.array(np.concatenate(kept)), as_long(one), as_long(two)],
                ["doc_id", "_th", "_at", "_end", "_kept", "_h1", "_h2"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "_th", "_text", "_cuts", "_ats").mapInArrow(made, f"doc_id {kind}, _th bigint, _at int, _end int, _kept boolean, _h1 bigint, _h2 bigint")


def repeated(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The repeated runs and then the repeated passages of every document that has any: (_id, _own, _cuts) and (_id, _own, _gone), stretches of words."""
    every = saved(marks(docs, run, min_words), "marks")
    later = later_places(every.where(F.col("kind") == MARK_RUN), "first-runs")
    cuts = saved(per_document(stretches(later.select("doc_id", "_th", "_at", "_end")), "_cuts"), "cuts", shrink=2)

    pieces = every.where(F.col("kind") == MARK_PIECE)
    again = later_places(pieces, "first-pieces")
    again = again.join(cuts, of_document(again, cuts), "left")
    kept = again.where(F.col("_cuts").isNull() | ~F.exists("_cuts", lambda c: (F.col("_at") < c["_end"]) & (F.col("_end") > c["_start"])))
    kept = saved(kept.select(F.col("_h1").alias("_h")).distinct(), "kept", shrink=8)
    near = pieces.join(small(kept, kept.count()), F.col("_h1") == F.col("_h"), "left_semi")
    near = saved(near.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_own")).agg(F.collect_set("_at").alias("_ats")), "near", shrink=4)

    ids = near.select("_id", "_own")
    ids = small(ids, ids.count())
    texts = keyed(docs, "doc_id")
    texts = texts.join(ids, of_document(texts, ids), "left_semi").dropDuplicates(["doc_id", "_th"])
    texts = texts.join(near, of_document(texts, near)).select("doc_id", "_th", "_text", "_ats")
    texts = texts.join(cuts, of_document(texts, cuts), "left").select("doc_id", "_th", "_text", "_cuts", "_ats")
    found = saved(windows(texts).withColumn("_place", place()), "windows")
    firsts = found.groupBy("_h1", "_h2").agg(F.min("_place").alias("_first"), F.max(F.when(F.col("_kept"), F.col("_place"))).alias("_last")).where("_last > _first").drop("_last")
    passages = found.where("_kept").join(saved(firsts, "first-windows", shrink=4), ["_h1", "_h2"]).where(F.col("_place") > F.col("_first")).select("doc_id", "_th", "_at", "_end")
    return cuts, saved(per_document(stretches(passages), "_gone"), "gone", shrink=4)


def cut(text: str, cuts: list[dict] | None, gone: list[dict] | None) -> tuple[str, int, int]:
    """The text without the words of both, its number of sentences, and of those removed whole or in part."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends = bounds(raw)
    n = len(starts)
    if not n:
        return text, 0, 0
    sentence = np.cumsum(openings(raw, starts, ends)) - 1
    lost = inside(cuts, n) | inside(gone, n)
    if not lost.any():
        return text, int(sentence[-1]) + 1, 0
    edges = np.concatenate([[0], ends[:-1], [len(raw)]])  # of each word with the white space before it, and after the last
    keep = np.repeat(~lost, np.diff(edges))
    return raw[keep].tobytes().decode().lstrip(" "), int(sentence[-1]) + 1, len(np.unique(sentence[lost]))


def cut_texts(text: Column, cuts: Column, gone: Column) -> Column:
    """Struct of what ``cut`` gives."""

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def made(texts: pd.Series, cuts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(*x) for x in zip(texts, cuts, gone, strict=True)], columns=["text", "n_sentences", "n_removed"])

    return made(text, cuts, gone)


def dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """``docs`` with repeated sentences and passages removed from text; with ``counts`` also n_sentences and n_removed (whole or in part)."""
    rows, names = covered(docs)
    cuts, gone = repeated(docs, run, min_words)
    more = gone.select(F.col("_id").alias("_id2"), F.col("_own").alias("_own2"), "_gone")
    both = cuts.join(more, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_own") == F.col("_own2")), "full")
    both = saved(both.select(F.when(F.col("_own").isNull(), F.col("_id2")).otherwise(F.col("_id")).alias("_id"), F.coalesce("_own", "_own2").alias("_own"), "_cuts", "_gone"), "both", shrink=2)
    python_batches(docs.sparkSession)
    text = F.col(names["text"])
    joined = rows.join(both.hint("merge"), F.col(names["doc_id"]).eqNullSafe(F.col("_id")) & (F.xxhash64(text_of(names["text"])) == F.col("_own")), "left")
    made = joined.select(*names.values(), cut_texts(text_of(names["text"]), F.col("_cuts"), F.col("_gone")).alias("_made"))
    out = [F.when(text.isNotNull(), F.col("_made.text")).alias(c) if c == "text" else F.col(new).alias(c) for c, new in names.items()]
    return made.select(*out, *([F.col("_made.n_sentences"), F.col("_made.n_removed")] if counts else []))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat earlier ones."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
