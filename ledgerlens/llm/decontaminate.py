"""Benchmark decontamination: document word windows against a broadcast hash set of benchmark n-grams.

Every benchmark item becomes windows of ``n`` consecutive words (an item of fewer words is one window). Documents are cut into words
once; the hashes of their windows of all lengths that occur are looked up in the hashes of the benchmark's windows, and the places
found, a document's id and a position each, are verified on the words of the documents that have any.
The scan is one pass with one hash join, without a shuffle of documents. The window hashes are counted before they are broadcast;
above ``BROADCAST_ROWS`` they are joined by shuffle, of ids, positions and hashes only.

Edge cases: null and empty texts have no words, no hits and no items; repeated rows get equal results; null ids are kept;
items without words are ignored; an empty benchmark contaminates nothing; other columns are not read, and come back as they were
whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import covered, keyed, same_row, saved, small, text_of, uncovered

WINDOW_WORDS = 10

#: What ends a word: ASCII that is neither letter nor digit, listed character by character, which Java tests by table and not range by range.
BREAKS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())

#: A word before A-Z are lower-cased: digits, ASCII letters and all that is not ASCII.
RAW_WORD = f"[^{BREAKS}]++"


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))


def normalised(text: Column) -> Column:
    """A-Z, and nothing else, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_hashes(words: Column) -> Column:
    """Hashes of fully lower-cased words: equal normalised words have equal hashes; matches are verified later."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def window_hash(at: Column, length: int) -> Column:
    """The hash of the ``length`` words from ``at`` on; null if there are fewer."""
    return F.when(at + length <= F.size("_wh"), F.xxhash64(*[F.get("_wh", at + i) for i in range(length)]))


def window_text(at: Column, length: Column) -> Column:
    return normalised(F.array_join(F.slice("_words", at + 1, length), " "))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (item_id, _len, _hash, _window) of the benchmark."""
    items = benchmark.select("item_id", raw_words(F.coalesce("text", F.lit(""))).alias("_words")).withColumn("_wh", word_hashes(F.col("_words")))
    items = items.withColumn("_len", F.least(F.lit(n), F.size("_words")))
    spots = items.select("item_id", "_words", "_wh", "_len", F.explode(F.when(F.col("_len") > 0, F.sequence(F.lit(0), F.size("_words") - F.col("_len")))).alias("_at"))
    hashed = F.coalesce(*[F.when(F.col("_len") == k, window_hash(F.col("_at"), k)) for k in range(1, n + 1)])
    return spots.select("item_id", "_len", hashed.alias("_hash"), window_text(F.col("_at"), F.col("_len")).alias("_window")).distinct()


def places(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, _th, _at, _len, _hash): where a document's window has the length and hash of one of ``grams``, in one pass over ``docs``."""
    texts = keyed(docs, "doc_id").select("doc_id", "_th", word_hashes(raw_words(F.col("_text"))).alias("_wh"))
    last = F.size("_wh") - lengths[0]
    spots = texts.select("doc_id", "_th", "_wh", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("_at"))
    if len(lengths) == 1:
        found = spots.select("doc_id", "_th", "_at", F.lit(lengths[0]).alias("_len"), window_hash(F.col("_at"), lengths[0]).alias("_hash"))
    else:
        each = F.array(*[F.struct(F.lit(k).alias("n"), window_hash(F.col("_at"), k).alias("h")) for k in lengths])
        found = spots.select("doc_id", "_th", "_at", F.explode(each).alias("_w")).select("doc_id", "_th", "_at", F.col("_w.n").alias("_len"), F.col("_w.h").alias("_hash"))
    known = saved(grams.select(F.col("_hash").alias("_h"), F.col("_len").alias("_l")).distinct(), "hashes", shrink=8)
    return found.join(small(known, known.count()), (F.col("_hash") == F.col("_h")) & (F.col("_len") == F.col("_l")), "left_semi")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, _th, _at, _end, item_id): each verified occurrence of a benchmark window; _at and _end count words."""
    grams = saved(benchmark_windows(benchmark, n), "grams", shrink=8)
    lengths = sorted(r["_len"] for r in grams.select("_len").distinct().collect())  # at most n rows
    spots = saved(places(docs, grams, lengths or [n]), "places", shrink=4)
    per = spots.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_own")).agg(F.collect_set(F.struct("_at", "_len", "_hash")).alias("_spots"))
    per = saved(per, "spots", shrink=8)
    texts = keyed(docs, "doc_id")
    few = small(per, per.count())
    texts = texts.join(few, texts["doc_id"].eqNullSafe(few["_id"]) & (texts["_th"] == few["_own"])).select("doc_id", "_th", raw_words(F.col("_text")).alias("_words"), "_spots")
    told = texts.select("doc_id", "_th", "_words", F.explode("_spots").alias("_s"))
    told = told.select("doc_id", "_th", F.col("_s._at").alias("_at"), F.col("_s._len").alias("_n"), F.col("_s._hash").alias("_h"), window_text(F.col("_s._at"), F.col("_s._len")).alias("_t"))
    found = told.join(small(grams, grams.count()), (F.col("_h") == F.col("_hash")) & (F.col("_t") == F.col("_window")))
    return found.select("doc_id", "_th", "_at", (F.col("_at") + F.col("_n")).alias("_end"), "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside a hit), items (sorted ids as text), and _th.

    Hits of a document may overlap; a running maximum of their ends counts every word once.
    """
    order = Window.partitionBy("doc_id", "_th").orderBy("_at", "_end")
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits(docs, benchmark, n).distinct().repartition("doc_id", "_th").withColumn("_new", F.greatest(F.lit(0), F.col("_end") - F.greatest("_at", F.coalesce(before, F.lit(0)))))
    per = marked.groupBy("doc_id", "_th").agg(F.sum("_new").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    base = keyed(docs, "doc_id").select("doc_id", "_th", F.regexp_count("_text", F.lit(RAW_WORD)).cast("long").alias("n_words"))
    joined = base.join(per, same_row(base, per, "doc_id", "_th"), "left")
    return joined.select(base["doc_id"], base["_th"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, mode: str = "document") -> DataFrame:
    """``docs`` without contaminated documents (mode "document"), or with the hit words' spans cut out (mode "span").

    Cutting keeps the text before and after each run of hit words. Columns of ``docs`` are returned as they are.
    """
    rows, names = covered(docs)
    th = F.xxhash64(text_of(names["text"]))
    own = lambda other: F.col(names["doc_id"]).eqNullSafe(F.col(other)) & (th == F.col("_own"))
    if mode == "document":
        bad = saved(hits(docs, benchmark, n).select(F.col("doc_id").alias("_id"), F.col("_th").alias("_own")).distinct(), "bad", shrink=8)
        return uncovered(rows.join(small(bad, bad.count()), own("_id"), "left_anti"), names)
    if mode != "span":
        raise ValueError(f"unknown mode {mode!r}")
    order = Window.partitionBy("doc_id", "_th").orderBy("_at")
    edge = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits(docs, benchmark, n).select("doc_id", "_th", "_at", "_end").distinct()
    runs = runs.withColumn("_edge", edge)
    runs = runs.withColumn("_run", F.sum(F.when(F.col("_at") <= F.col("_edge"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "_th", "_run").agg(F.min("_at").alias("_at"), F.max("_end").alias("_end"))
    cuts = runs.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_own")).agg(F.sort_array(F.collect_list(F.struct("_at", "_end"))).alias("_cuts"))
    text = F.col(names["text"])
    units = F.regexp_extract_all(text, F.lit(f"[{BREAKS}]*+(?:{RAW_WORD}|$)"), F.lit(0))
    kept = F.filter(units, lambda _, i: ~F.exists("_cuts", lambda c: (i >= c["_at"]) & (i < c["_end"])))
    return uncovered(rows.join(cuts, own("_id"), "left"), names, text=F.when(F.col("_cuts").isNull(), text).otherwise(F.ltrim(F.array_join(kept, ""))))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark."""
    from .common import table

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
