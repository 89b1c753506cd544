"""Embeddings fitted to the corpus: weighted word counts in a truncated singular value decomposition, where no language model is at hand.

Words are hashed to ``features`` places (JVM-side), counted in logarithms, weighted by how few documents have them and scaled to unit length. The
decomposition is a randomised range finder: a block of random directions is multiplied by the documents' matrix and its transpose a
few times, orthonormalised on the driver in between, and the small product in that range gives the components. Every multiplication
is one pass whose partitions give a matrix of ``features`` rows and a hundred columns at most, added up by a hash aggregate. The driver
and each task hold matrices of that size, whatever the number of documents.

Null and empty texts, and those without words, have zero vectors; repeated texts weigh as often as they come; an empty table gives a
model whose vectors are all zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.matrices import summed
from ledgerlens.functions.storage import written
from ledgerlens.functions.text import WORD

FEATURES = 4096
DIMS = 64
#: Random directions beyond the wanted ones, and passes that sharpen the range.
EXTRA, POWERS = 16, 2


@dataclass
class Semantic:
    """Weights of word places, and the directions (places x dimensions) with their singular values."""

    weights: np.ndarray
    components: np.ndarray
    values: np.ndarray


def places(text: Column, features: int = FEATURES) -> Column:
    """The place of each word of a text, in lower case."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def counted(column: pa.ListArray, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and count of every different place of every row, in order."""
    offsets, flat = np.asarray(column.offsets), column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    key, count = np.unique(row.astype(np.int64) * features + flat, return_counts=True)
    return key // features, key % features, count


def weighted(column: pa.ListArray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and weight, rows of unit length."""
    row, place, count = counted(column, len(weights))
    value = (1 + np.log(count)) * weights[place]
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(column)))
    return row, place, value / norm[row]


def projected(column: pa.ListArray, weights: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The rows' coordinates along ``directions``."""
    return along_rows(*weighted(column, weights), directions, len(column))


def along_rows(row: np.ndarray, place: np.ndarray, value: np.ndarray, directions: np.ndarray, rows: int) -> np.ndarray:
    """The products of ``rows`` sparse rows with ``directions``."""
    out = np.zeros((rows, directions.shape[1]))
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.add.reduceat(value[:, None] * directions[place], first, axis=0)
    return out


def fit(docs: DataFrame, text: str = "text", dims: int = DIMS, features: int = FEATURES, seed: int = 7) -> Semantic:
    """The model of all texts of ``docs``."""
    rows = docs.select(places(F.col(text), features).alias("w")).where(F.size("w") > 0)
    rows = written(rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "places")  # evenly, as five passes follow

    def frequencies(batch: pa.RecordBatch) -> np.ndarray:
        _, place, _ = counted(batch.column(0), features)
        return np.bincount(np.append(place, features), minlength=features + 1)[:, None] + np.where(np.arange(features + 1) == features, batch.num_rows - 1.0, 0.0)[:, None]

    seen = summed(rows, frequencies, features + 1, 1)[:, 0]
    weights = np.log((1 + seen[features]) / (1 + seen[:features])) + 1
    width = min(dims + EXTRA, features)
    found = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        row, place, value = weighted(batch.column(0), weights)
        out = np.zeros((features, width))
        if len(row):
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(place[order]) > 0))
            along = along_rows(row, place, value, found, batch.num_rows)
            out[place[order][first]] = np.add.reduceat(along[row[order]] * value[order, None], first, axis=0)
        return out

    for _ in range(POWERS + 1):
        found = np.linalg.qr(summed(rows, spread, features, width))[0]

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = projected(batch.column(0), weights, found)
        return z.T @ z

    values, turn = np.linalg.eigh(summed(rows, products, width, width))
    top = np.argsort(-values)[:dims]
    kept = np.sqrt(np.clip(values[top], 0, None))
    return Semantic(weights, np.where(kept > 0, found @ turn[:, top], 0.0), kept)


def embedder(model: Semantic, spark: SparkSession):
    """A function of a text column that gives its vector, of unit length, as array<float>."""
    shared = spark.sparkContext.broadcast((model.weights, model.components))
    features = len(model.weights)

    @F.pandas_udf("array<float>")
    def vectors(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, components = shared.value
        for words in columns:
            lists = pa.array([w if w is not None else [] for w in words], pa.list_(pa.int32()))
            found = projected(lists, weights, components)
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            yield pd.Series(list((found / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return lambda text: vectors(places(text, features))


def save(spark: SparkSession, model: Semantic, path: str) -> None:
    """A row per place of words: weight and coordinates; and the singular values."""
    spark.createDataFrame([(i, float(w), c.tolist()) for i, (w, c) in enumerate(zip(model.weights, model.components, strict=True))], "place int, weight double, coordinates array<double>").write.mode("overwrite").parquet(f"{path}/places")
    spark.createDataFrame([(float(v),) for v in model.values], "value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/values")


def load(spark: SparkSession, path: str) -> Semantic:
    rows = spark.read.parquet(f"{path}/places").orderBy("place").collect()  # as many as there are features
    values = sorted((r["value"] for r in spark.read.parquet(f"{path}/values").collect()), reverse=True)
    return Semantic(np.array([r["weight"] for r in rows]), np.array([r["coordinates"] for r in rows]), np.array(values))
