"""Embedding whitening by a distributed centred scatter and cyclic Jacobi rotations on the driver.

Entries become integers (``floor(SCALE * c) + SHIFT``), so that sums, means and deviations are exact. The model is fitted on each
distinct integer vector once: a first pass counts them and sums their entries, a second one sums the products of the centred entries,
each partition in numpy and all partitions by a hash aggregate over matrix places. The driver gets one matrix of the vectors'
dimension, turns it by rotations of disjoint pairs, round after round of a tournament in which every pair meets once a sweep, until
nothing is left beside the diagonal (small eigenvalues come out as accurate as large ones), sorts by eigenvalue and broadcasts the
matrix that whitens. A third pass measures the covariance of what was whitened against the identity.

The driver and each task hold some matrices of dimension x dimension; ``MOST`` bounds the dimension.

Edge cases: rows whose vector is null or empty, or holds null, NaN or infinite entries, are dropped; so are rows of another length
than the most common one (of equally common lengths, the longest). Entries beyond 2**52 in absolute value, once scaled, count as
that. Repeated rows count once in the fit and come back each; null ids are kept. Directions without variance (an eigenvalue below
rounding, dimension x 2**-52 of the largest) have no component, so that a table of equal vectors, or an empty one, gives no
components at all. Of equal eigenvalues the rotations' order decides. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_batches, saved, table

SCALE = 64
SHIFT = 1_000_000
#: Scaled entries are held within this.
FAR = 1 << 52
#: Dimensions of a vector at most; a matrix of so many squared has 128 MB.
MOST = 4096
#: Sweeps of rotations at most; about ten are needed.
SWEEPS = 60
INT64 = (1 << 63) - 1


@dataclass
class Model:
    """``n`` distinct vectors with sums per dimension; eigenvalues and unit eigenvectors (columns), falling; each one's share of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def matrix(self) -> np.ndarray:
        """What centred vectors are multiplied by."""
        return self.vectors / np.sqrt(self.values)


def integers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key`` and _x, the integer vector, of the rows that take part, whatever their length."""
    c = F.col(vector)
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def whole(e: Column) -> Column:
        scaled = F.lit(float(SCALE)) * e.cast("double")
        return F.floor(F.greatest(F.least(scaled, F.lit(float(FAR))), F.lit(-float(FAR)))) + F.lit(SHIFT)

    return rows.select(F.col(key), F.col(vector).cast("array<double>").alias("_c")).withColumnRenamed("_c", vector).where((F.size(c) > 0) & fine).select(key, F.transform(c, whole).alias("_x"))


def vectors_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, d: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all _x of the matrices that ``make`` gives for a batch, added up in each partition and then place by place."""
    python_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(vectors_of(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    places = rows.select("_x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((int(places["i"].max()) + 1, int(places["j"].max()) + 1))
    out[places["i"], places["j"]] = places["v"]
    return out


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and sums per dimension of _x, exact at any size."""
    python_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = vectors_of(batch.column(0), d)
            n += len(x)
            for lot in np.array_split(x, len(x) // 256 + 1):  # 256 entries of at most 2**53 don't overflow
                total = [a + b for a, b in zip(total, lot.sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))], ["i", "v"])

    found = {r["i"]: int(r["v"]) for r in rows.select("_x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: whole parts are taken off as integers, so that only the fraction is rounded."""
    return (x - np.array([s // n for s in sums], np.int64)) - np.array([s % n / n for s in sums])


def rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (p < q) of a tournament: each round is disjoint, and all rounds together have every pair once."""
    ring = list(range(d + d % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[::-1][:half], strict=True) if max(a, b) < d]
        yield np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations."""
    a = (matrix + matrix.T) / 2
    d = len(a)
    v = np.eye(d)
    order = list(rounds(d))
    for _ in range(SWEEPS):
        turned = False
        for p, q in order:
            off = a[p, q]
            # what is beyond rounding beside both diagonal entries, not beside the largest of all
            live = np.abs(off) > 2.0**-54 * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q, off = p[live], q[live], off[live]
            if not len(p):
                continue
            turned = True
            theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            diagonal = a[p, p] - t * off, a[q, q] + t * off
            a[:, p], a[:, q] = a[:, p] * c - a[:, q] * s, a[:, p] * s + a[:, q] * c
            a[p, :], a[q, :] = a[p, :] * c[:, None] - a[q, :] * s[:, None], a[p, :] * s[:, None] + a[q, :] * c[:, None]
            a[p, p], a[q, q] = diagonal
            a[p, q] = a[q, p] = 0.0
            v[:, p], v[:, q] = v[:, p] * c - v[:, q] * s, v[:, p] * s + v[:, q] * c
        if not turned:
            break
    falling = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[falling], v[:, falling] / np.linalg.norm(v[:, falling], axis=0)


def dimension(rows: DataFrame) -> int:
    """The most common length of _x, 0 without rows."""
    found = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if found and found["d"] > MOST:
        raise ValueError(f"vectors of {found['d']} dimensions; at most {MOST} are taken")
    return found["d"] if found else 0


def fit(rows: DataFrame, components: int) -> Model:
    """The model of ``rows`` (_x, all of one length), of at most so many ``components``."""
    d = dimension(rows)
    own = saved(rows.select("_x").distinct(), "whitening-fit")
    n, sums = exact_sums(own, d) if d else (0, [])
    if not n:
        return Model(0, sums, np.zeros(0), np.zeros((d, 0)), np.zeros(0))

    def scatter(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums)
        return np.vstack([y.T @ y, y.sum(axis=0)])

    found = summed(own, d, scatter)
    covariance, left = found[:d] / n, found[d] / n  # what rounding leaves of the mean
    values, vectors = jacobi(covariance)
    keep = min(components, int((values > d * 2.0**-52 * max(values[0], 0.0)).sum()))
    model = Model(n, sums, values[:keep], vectors[:, :keep], values[:keep] / np.trace(covariance))
    if keep:
        matrix, mean = model.matrix, left @ model.matrix

        def white(x: np.ndarray) -> np.ndarray:
            w = centred(x, n, sums) @ matrix - mean
            return w.T @ w

        model.identity_error = float(np.abs(summed(own, d, white) / n - np.eye(keep)).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums over dimensions of (n x - S) squared: in 64 bits where all fits, else in Python's integers."""
    d = x.shape[1]
    offset, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    y = x - offset  # n x - S = n y - rest, and rest < n
    if n * (int(np.abs(y).max(initial=0)) + 1) <= int((INT64 // d) ** 0.5):
        z = n * y - rest
        return (z * z).sum(axis=1).tolist()
    return [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in y.tolist()]


def whiten(rows: DataFrame, model: Model, key: str = "vec_id") -> DataFrame:
    """``key``, deviation (decimal(38,0), null beyond 38 digits) and whitened (one entry per component) of ``rows`` (``key``, _x)."""
    session = rows.sparkSession
    python_batches(session)
    d, n, sums = len(model.sums), model.n, model.sums
    sent = session.sparkContext.broadcast(model.matrix)  # d x components
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors_of(batch.column(1), d)
            w = centred(x, n, sums) @ sent.value
            far = pa.array([Decimal(v) if v < 10**38 else None for v in deviations(x, n, sums)], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), far, lists], [key, "deviation", "whitened"])

    return rows.select(key, "_x").where(F.size("_x") == d if n else F.lit(False)).mapInArrow(run, kind)


def whitened(table_: DataFrame, components: int = 16, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, Model]:
    """``whiten`` of a table's vectors by the model fitted on them, and that model."""
    rows = integers(table_, vector, key)
    d = dimension(rows)
    rows = rows.where(F.size("_x") == d)
    model = fit(rows, components)
    return whiten(rows, model, key), model


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """One row per vector and component; a deviation beyond 64 bits is null here (``whiten`` has it)."""
    rows, model = whitened(table(spark, sf_dir, "embeddings"))
    explained = F.array(*map(F.lit, map(float, model.explained))).cast("array<double>")
    long = rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
    return long.select("vec_id", "deviation", F.posexplode("whitened").alias("_i", "whitened")).select(
        "vec_id", (F.col("_i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_i")).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
