"""Whitening against numpy's own eigenvectors and exact integers; odd vectors, repeats, equal vectors, empty tables, clashing columns."""

import math

import numpy as np
import pytest

from ledgerlens.llm import whitening
from ledgerlens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n long, deviation string, _x int"


def fitted(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    return x, distinct, distinct.sum(axis=0)


@pytest.mark.parametrize("d", [1, 2, 5, 8, 33])
def test_rotations(d):
    a = np.random.default_rng(d).normal(size=(d, 3 * d)) * 10.0 ** -np.arange(d)[:, None].clip(0, 6)
    values, vectors = whitening.jacobi(a @ a.T)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    assert np.allclose(vectors * values @ vectors.T, a @ a.T, rtol=1e-12, atol=1e-12 * values[0])
    assert (np.diff(values) <= 0).all()
    pairs = [(p, q) for one, two in whitening.rounds(d) for p, q in zip(one.tolist(), two.tolist(), strict=True)]
    assert sorted(pairs) == [(p, q) for p in range(d) for q in range(p + 1, d)]


def test_small_eigenvalues_are_accurate():
    scales = 10.0 ** -np.arange(0, 12, 2)
    a = np.array([[1.0 / (i + j + 1) + (i == j) for j in range(6)] for i in range(6)])
    values = whitening.jacobi(scales[:, None] * a * scales)[0]
    exact = np.linalg.eigvalsh(a[5:, 5:])[0]
    assert 0.3 * exact * scales[-1] ** 2 < values[-1] <= exact * scales[-1] ** 2  # not lost beside the largest, 10**20 times as large


def test_query_against_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, distinct, sums = fitted([r["embedding"] for r in rows])
    n = len(distinct)
    centred = distinct - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    got = QUERIES["op11_whitening"](spark, sf).orderBy("vec_id", "component").collect()
    assert [(g["vec_id"], g["component"]) for g in got] == [(r["vec_id"], k) for r in rows for k in range(1, 17)]
    white = np.array([g["whitened"] for g in got]).reshape(-1, 16)
    want = (x - sums / n) @ vectors / np.sqrt(values)
    assert np.allclose(white * np.sign((white * want).sum(axis=0)), want, atol=1e-8)
    assert {g["n"] for g in got} == {n}
    assert [g["deviation"] for g in got[::16]] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, sums, strict=True)) for v in x]
    assert np.allclose([g["explained"] for g in got[:16]], values / np.trace(covariance), rtol=1e-9)
    assert {g["identity_error"] for g in got} == {got[0]["identity_error"]} and 0 <= got[0]["identity_error"] < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.5, 1.0, -2.0]), (1, [0.5, 1.0, -2.0]), (2, None), (3, []), (4, [0.1, None, 0.3]), (5, [nan, 0.0, 1.0]), (6, [0.0, -inf, 1.0]), (None, [3.0, 0.25, 1.0]), (7, [0.0, 0.0, 0.0]), (8, [1.0, 2.0]), (9, [-1.5, 0.7, 9.0]), (10, [0.5, 1.0, -2.0])]
    rows, model = whitening.whitened(spark.createDataFrame([(i, v, 1, "d", 2) for i, v in vectors], SCHEMA), components=16)
    kept = [(1, [0.5, 1, -2]), (1, [0.5, 1, -2]), (None, [3, 0.25, 1]), (7, [0, 0, 0]), (9, [-1.5, np.float32(0.7), 9]), (10, [0.5, 1, -2])]
    x, distinct, sums = fitted([v for _, v in kept])
    assert model.n == 4 == len(distinct) and model.sums == sums.tolist() and len(model.values) == 3
    want = sorted((i is None, i or 0, sum((4 * int(a) - int(b)) ** 2 for a, b in zip(v, sums, strict=True))) for (i, _), v in zip(kept, x, strict=True))
    got = rows.collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"])) for r in got) == want
    assert all(len(r["whitened"]) == 3 for r in got)
    white = np.array([r["whitened"] for r in got if r["vec_id"] != 10 and r["vec_id"] != 1] + [next(r["whitened"] for r in got if r["vec_id"] == 1)])
    assert np.allclose(white.T @ white / 4, np.eye(3), atol=1e-9) and model.identity_error < 1e-9


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        rows, model = whitening.whitened(spark.createDataFrame([(i, v, 1, "d", 2) for i, v in vectors], SCHEMA))
        assert len(model.values) == 0 and [list(r["whitened"]) for r in rows.collect()] == [[]] * (len(vectors) if len(vectors) == 2 else 0)


def test_rank_below_the_dimension(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0], 1, "d", 2) for i in range(9)]
    _, model = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert len(model.values) == 1 and math.isclose(model.explained[0], 1.0) and model.identity_error < 1e-12


def test_exact_beyond_64_bits(spark):
    rows, model = whitening.whitened(spark.createDataFrame([(i, [1e30 if i == 3 else i * 1e6, -1e12 * i, 1.0], 1, "d", 2) for i in range(6)], SCHEMA))
    x = [[math.floor(max(-(2.0**52), min(2.0**52, 64 * float(np.float32(c))))) + 1_000_000 for c in (1e30 if i == 3 else i * 1e6, -1e12 * i, 1.0)] for i in range(6)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert model.sums == sums
    assert {r["vec_id"]: int(r["deviation"]) for r in rows.collect()} == {i: sum((6 * a - b) ** 2 for a, b in zip(v, sums, strict=True)) for i, v in enumerate(x)}
