"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has character and word features of its own and of the lines before and after it. The field labels lines good or bad;
the forward-backward marginals of "good", weighted by line length, give a document's mean, and a logistic curve fitted on the
training documents turns that mean into the score. Nothing but the text is an input.

Training is on at most ``TRAIN_DOCS`` labelled documents of at most ``TRAIN_CHARS`` characters and ``TRAIN_LINES`` lines, those with
the smallest hashes of doc_id (the least text, where an id has several), among rows whose crc32(doc_id) mod 3 is not 1. Documents carry one label; their lines start with it, and lines of
bad documents that a first field finds clearly good, beside worse ones, are relabelled before the second fit. Features are computed on the
executors and only they reach the driver. Scoring is row by row, without a shuffle.

Edge cases: null and empty texts are one empty line and get the score that the field gives it; repeated rows score alike; texts
of any length are scored whole; with no usable labels of both kinds all scores are 0.5; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_batches, table

TRAIN_DOCS = 3000
TRAIN_CHARS = 100_000
TRAIN_LINES = 200
#: Characters that are looked at together; longer texts are looked at alone.
BLOCK_CHARS = 1_000_000
BASE = 14

SPACE, LOWER, UPPER, DIGIT, STOP, BANG, PIPE, SYMBOL, OTHER = range(9)


def classes() -> np.ndarray:
    """The class of each of the first code points, OTHER for the marks and letters beyond."""
    kinds = np.full(0x600, OTHER, np.uint8)
    for i in range(0x600):
        c = chr(i)
        if c.isspace():
            kinds[i] = SPACE
        elif c.islower():
            kinds[i] = LOWER
        elif c.isupper():
            kinds[i] = UPPER
        elif c.isdigit():
            kinds[i] = DIGIT
        elif c in ".,;:?'\"()-":
            kinds[i] = STOP
        elif c == "!":
            kinds[i] = BANG
        elif c in "|\t":
            kinds[i] = PIPE
        elif i < 0x80:
            kinds[i] = SYMBOL
    return kinds


KINDS = classes()
SCRAMBLE = np.random.default_rng(7).integers(1, 2**62, 4096, dtype=np.int64)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and the number of lines of each text."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = KINDS[np.minimum(points, len(KINDS) - 1)]
    ends = np.flatnonzero(points == 10) + 1
    starts = np.concatenate(([0], ends[:-1]))
    length = (ends - starts - 1).astype(np.float64)
    counts = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(9)], axis=1).astype(np.float64)
    counts[:, SPACE] -= 1  # the line's end
    inside = kinds != SPACE
    first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    line_of = np.searchsorted(ends, first, "right")
    words = np.bincount(line_of, minlength=len(ends)).astype(np.float64)
    again = np.zeros(len(ends))
    if len(first):
        mixed = np.where(inside, SCRAMBLE[points & 4095], 0)
        names = np.add.reduceat(mixed, first)
        same = np.concatenate(([False], (names[1:] == names[:-1]) & (line_of[1:] == line_of[:-1])))
        again = np.bincount(line_of[same], minlength=len(ends)).astype(np.float64)
    safe, safe_words = np.maximum(length, 1), np.maximum(words, 1)
    x = np.empty((len(ends), BASE))
    x[:, :9] = 5 * counts / safe[:, None]
    x[:, 9] = again / safe_words
    x[:, 10] = np.minimum((length - counts[:, SPACE]) / safe_words, 20) / 10
    x[:, 11] = np.log1p(length) / 5
    x[:, 12] = np.minimum(words, 5) / 5
    x[:, 13] = np.minimum((counts[:, SYMBOL] + counts[:, BANG] + counts[:, PIPE]) / safe_words, 3)
    return x, length, np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A constant, the line's features, and those of the lines before and after it in the same document."""
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    before, after = np.vstack([x[:1], x[:-1]]), np.vstack([x[1:], x[-1:]])
    before[first] = 0
    after[last] = 0
    return np.hstack([np.ones((len(x), 1)), x, before, after])


def marginals(emission: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of transitions (from, to), by scaled forward-backward over all documents at once.

    ``emission``: log odds of good; ``transition``: log weights.
    """
    n, first = len(emission), np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    starts, sizes = first[order], lines[order]
    e = np.stack([np.ones(n), np.exp(np.clip(emission, -30, 30))], axis=1)
    t = np.exp(transition)
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right") if n else []
    forward, backward = np.empty((n, 2)), np.empty((n, 2))
    for step, k in enumerate(alive):
        at = starts[:k] + step
        f = e[at] if step == 0 else (forward[at - 1] @ t) * e[at]
        forward[at] = f / f.sum(axis=1, keepdims=True)
    backward[first + lines - 1] = 1.0
    for step in range(len(alive) - 1, 0, -1):
        at = starts[: alive[step]] + step
        b = (backward[at] * e[at]) @ t.T
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(axis=1)
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] * t[None] * (e[at] * backward[at])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair.sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray
    transition: np.ndarray
    scale: float = 0.0
    offset: float = 0.0

    def means(self, texts: list[str]) -> np.ndarray:
        x, length, lines = line_features(texts)
        return self.mean_of(with_neighbours(x, lines), length, lines)

    def mean_of(self, x: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        good, _ = marginals(x @ self.weights, self.transition, lines)
        first = np.cumsum(lines) - lines
        w = length + 1
        return np.add.reduceat(good * w, first) / np.add.reduceat(w, first)

    def scores(self, texts: list[str]) -> np.ndarray:
        out, block, size = [], [], 0
        for t in texts:
            if block and size + len(t) > BLOCK_CHARS:
                out.append(self.means(block))
                block, size = [], 0
            block.append(t)
            size += len(t)
        if block:
            out.append(self.means(block))
        means = np.concatenate(out) if out else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * means + self.offset, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_field(x: np.ndarray, y: np.ndarray, lines: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> Model:
    """Maximum likelihood of labelled lines: emissions from a logistic start, then Adam on all weights."""
    n = len(y)
    first = np.cumsum(lines) - lines
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1.0)
    w = np.concatenate([logistic(x, y, ridge), np.zeros(4)])
    m, v, data = np.zeros_like(w), np.zeros_like(w), x.T @ y
    for i in range(1, rounds + 1):
        good, pairs = marginals(x @ w[:-4], w[-4:].reshape(2, 2), lines)
        g = (np.concatenate([data - x.T @ good, (seen - pairs).ravel()]) - ridge * w) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9) * (1 - i / (rounds + 1))
    return Model(w[:-4], w[-4:].reshape(2, 2))


def fit(x: np.ndarray, length: np.ndarray, lines: np.ndarray, quality: np.ndarray) -> Model:
    """A field and its calibration from lines' features and documents' labels."""
    if len(set(quality.tolist())) < 2:
        return Model(np.zeros(1 + 3 * BASE), np.zeros((2, 2)))
    x = with_neighbours(x, lines)
    doc_good = np.repeat(quality, lines).astype(float)
    model = fit_field(x, doc_good, lines)
    good, _ = marginals(x @ model.weights, model.transition, lines)
    worst = np.repeat(np.minimum.reduceat(good, np.cumsum(lines) - lines), lines)
    model = fit_field(x, np.where((doc_good == 0) & (good > 0.8) & (worst < 0.5), 1.0, doc_good), lines)
    means = model.mean_of(x, length, lines)
    b = logistic(np.stack([np.ones(len(means)), means], axis=1), quality.astype(float), 0.01)
    model.offset, model.scale = float(b[0]), float(b[1])
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS, max_lines: int = TRAIN_LINES) -> Model:
    """A model from a bounded sample of the labelled rows that aren't held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).where((F.length("_text") <= max_chars) & (F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) < max_lines))
    rows = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "_quality").agg(F.min("_text").alias("_text"))
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, length, _ = line_features([row.text])
                yield pd.DataFrame({"quality": [int(row.quality)], "x": [x.astype(np.float32).tobytes()], "n": [length.astype(np.float32).tobytes()]})

    found = rows.select(F.col("_text").alias("text"), F.col("_quality").alias("quality"), "doc_id").repartition(F.col("doc_id")).mapInPandas(run, "quality int, x binary, n binary").collect()
    found.sort(key=lambda r: (bytes(r["x"]), r["quality"]))
    if not found:
        return Model(np.zeros(1 + 3 * BASE), np.zeros((2, 2)))
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, BASE).astype(np.float64) for r in found]
    return fit(np.vstack(xs), np.concatenate([np.frombuffer(r["n"], np.float32) for r in found]).astype(np.float64), np.array([len(x) for x in xs]), np.array([r["quality"] for r in found]))


def score(model: Model, text: Column) -> Column:
    """The score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    python_batches(docs.sparkSession)
    return docs.where(score(model, docs["text"]) >= threshold)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
