"""Exact top-k search against all scores; ties, signs, extremes, odd vectors, empty tables."""

import numpy as np
import pytest

from ledgerlens.llm import exact_topk
from ledgerlens.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, _x long"


def best(queries, rows, k=5):
    out = []
    for own, q in queries:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), i is None, i or 0) for i, v in rows if i != own)  # noqa: B905  shorter vectors end in zeros
        out += [(own, place, None if no else i, -s) for place, (s, no, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def scaled(v):
    return [int(np.floor(256 * float(np.float32(c)))) for c in v]


def found(spark, rows, asked=None, k=5):
    df = spark.createDataFrame([(i, v, "s", 1, 2) for i, v in rows], SCHEMA)
    queries = df.where("vec_id % 50 = 0") if asked is None else df.where(df["vec_id"].isin(asked))
    return sorted(map(tuple, exact_topk.top_k(queries, df, k).collect()), key=str)


def test_query_against_all_scores(spark, sf):
    rows = [(r["vec_id"], scaled(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op13_topk"](spark, sf).collect()), key=str)
    assert got == best([r for r in rows if r[0] % 50 == 0], rows)
    assert "op13_topk" in ORACLE_SQL


@pytest.mark.parametrize(("seed", "spread", "d", "k"), [(0, 1.0, 7, 5), (1, 0.02, 3, 5), (2, 1.0, 1, 3), (3, 0.004, 16, 7), (4, -1.0, 6, 5)])
def test_random_vectors(spark, monkeypatch, seed, spread, d, k):
    """Small entries make many ties; a spread below 0 means entries of one sign only, so that losing terms decide."""
    monkeypatch.setattr(exact_topk, "QUERIES", 3)
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(size=(400, d))) if spread < 0 else rng.normal(size=(400, d)) * spread
    x[200:] *= -1 if spread < 0 else rng.random((200, d)) < 0.3  # sparse ones
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    ints = [(i, scaled(v)) for i, v in rows]
    assert found(spark, rows, k=k) == best([r for r in ints if r[0] % 50 == 0], ints, k)


@pytest.mark.parametrize("floor", [None, -10, 0, 1, 500, 4000])
def test_block_keeps_all_that_reach_the_floor(floor):
    rng = np.random.default_rng(5)
    x = rng.integers(-30, 31, (300, 6)) * (rng.random((300, 6)) < 0.6)
    block = exact_topk.Block(np.arange(300), x)
    for own in range(20):
        at, scores = block.best(own, x[own], 5, floor)
        got = dict(zip(block.ids[at].tolist(), scores.tolist(), strict=True))
        all_ = {i: int(s) for i, s in enumerate(x @ x[own]) if i != own}
        assert all(got[i] == all_[i] for i in got)
        assert {i for i, s in all_.items() if floor is None or s >= floor} <= got.keys()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -1.0, 0.5]), (0, [1.0, -1.0, 0.5]), (50, [0.0, 0.0, 0.0]), (1, [1.0, -1.0, 0.5]), (1, [1.0, -1.0, 0.5]), (None, [1.0, -1.0, 0.5]), (2, [1.0]), (3, [-4.0, 2.0, 1.0, 8.0])]
    away = [(100, None), (4, []), (5, [nan, 1.0, 1.0]), (150, [inf, 0.0, 0.0]), (6, [1.0, None, 1.0])]
    ints = [(i, scaled(v)) for i, v in rows]
    assert found(spark, rows + away) == best([r for r in ints if r[0] in (0, 50)], ints)


def test_extremes_dont_overflow(spark):
    got = found(spark, [(0, [3e38, 3e38]), (1, [3e38, 3e38]), (2, [-3e38, 1.0]), (3, [1.0, 1.0])])
    assert [g[2] for g in got] == [1, 3, 2] and got[0][3] > 0 > got[2][3]


def test_empty(spark):
    assert found(spark, []) == found(spark, [(1, [1.0])]) == found(spark, [(0, [1.0])]) == found(spark, [(0, None), (1, None)]) == []
