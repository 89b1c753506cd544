"""Corpus-fitted embeddings against a whole decomposition and by recall; the index against a search through all vectors, and what it spares."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import retrieval, semantic, vector_index


def dense(rows, weights):
    out = np.zeros((len(rows), len(weights)))
    for i, words in enumerate(rows):
        for w in set(words):
            out[i, w] = (1 + np.log(words.count(w))) * weights[w]
        if words:
            out[i] /= np.linalg.norm(out[i])
    return out


def test_directions_equal_a_whole_decomposition(spark):
    rng = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(5)]
    texts = [" ".join(rng.choice(rng.choice([topics[i % 5], topics[i % 5], ["the", "of"]])) for _ in range(rng.randrange(1, 40))) for i in range(160)] + ["", None, "!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(5)
    model = semantic.fit(docs, dims=5, features=256)
    rows = [r["w"] for r in docs.orderBy("i").select(semantic.places(F.col("text"), 256).alias("w")).collect()]
    seen = np.array([sum(w in r for r in rows if r) for w in range(256)])
    weights = np.log((1 + sum(map(bool, rows))) / (1 + seen)) + 1
    assert np.allclose(model.weights, weights)
    a = dense(rows, weights)
    _, values, turn = np.linalg.svd(a)
    assert np.allclose(model.values, values[:5], rtol=1e-3)
    assert np.allclose(model.components @ model.components.T, turn[:5].T @ turn[:5], atol=0.05)
    vectors = semantic.embedder(model, spark)
    got = np.array([r["v"] for r in docs.orderBy("i").select(vectors(F.col("text")).alias("v")).collect()])
    want = a @ model.components
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(norm > 0, norm, 1), atol=1e-5) and not got[160:].any()


def test_models_are_kept(spark, tmp_path):
    model = semantic.fit(spark.createDataFrame([("a b c",), ("a b",), ("d e f g",)], "text string"), dims=3, features=32)
    semantic.save(spark, model, f"file://{tmp_path}/m")
    again = semantic.load(spark, f"file://{tmp_path}/m")
    assert all(np.allclose(a, b) for a, b in zip((model.weights, model.components, model.values), (again.weights, again.components, again.values), strict=True))
    nothing = semantic.fit(spark.createDataFrame([("",), (None,)], "text string"), dims=3, features=32)
    assert not nothing.components.any() and nothing.components.shape == (32, 3)


def test_held_out_edited_texts_find_their_own(spark):
    """Texts that had no part in the fit, a fifth of their words dropped and the halves swapped: the own text is among the five nearest of all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vectors = semantic.embedder(semantic.fit(docs.where("doc_id % 4 <> 0")), spark)
    rng, edited = random.Random(2), []
    for r in docs.where("doc_id % 4 = 0").collect():
        words = [w for w in r["text"].split() if rng.random() > 0.2]
        if len(words) >= 20:
            edited.append((r["doc_id"], " ".join(words[len(words) // 2 :] + words[: len(words) // 2])))
    index = [(r["doc_id"], np.array(r["v"])) for r in docs.select("doc_id", vectors(F.col("text")).alias("v")).collect()]
    x, place = np.array([v for _, v in index]), {i: k for k, (i, _) in enumerate(index)}
    asked = spark.createDataFrame(edited, "i long, t string").select("i", vectors(F.col("t")).alias("v")).collect()
    near = np.array([r["v"] for r in asked]) @ x.T
    found = [(near[k] > near[k, place[r["i"]]] + 1e-6).sum() < 5 for k, r in enumerate(asked)]
    assert len(found) > 150 and np.mean(found) >= 0.9


def clustered(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return [(i, int(i % 3), (centres[i % 12] + spread * rng.normal(size=d)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("spread", "k", "key"), [(0.05, 5, None), (0.05, 3, "part"), (1.0, 7, None), (0.05, 1, None), (0.05, 400, "part")])
def test_index_equals_a_whole_search(spark, tmp_path, spread, k, key):
    rows = spark.createDataFrame([*clustered(4, 900, 8, spread), (900, 1, None), (901, 2, []), (902, 0, [1.0, 2.0]), (903, 1, [0.0] * 8), (904, 1, [0.0] * 8)], "chunk_id long, part int, v array<double>")
    index = vector_index.build(rows, f"file://{tmp_path}/index")
    asked = rows.where("chunk_id % 60 = 7").select(F.col("chunk_id").alias("query_id"), "part", F.col("v").alias("q"))
    found, told = vector_index.search(asked, index, k, key=key)
    whole = rows.where("size(v) = 8")
    if key is None:
        asked, whole = asked.withColumn("part", F.lit(0)), whole.withColumn("part", F.lit(0))
    want = retrieval.search(asked, whole, k, key="part")
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    share = told.first()
    assert share["queries"] == 15 and share["share_read"] <= 1
    if spread < 1 and k <= 5 and key is None:
        assert share["share_read"] < 0.25


def test_index_of_few_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "chunk_id long, v array<float>")
    index = vector_index.build(rows, f"file://{tmp_path}/i")
    found, _ = vector_index.search(spark.createDataFrame([("a", [3.0, 0.0]), ("b", [1.0])], "query_id string, q array<double>"), vector_index.opened(spark, index.path), 9)
    assert [(r["query_id"], r["chunk_id"], r["vector_rank"]) for r in found.orderBy("vector_rank").collect()] == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3)]
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.build(rows.limit(0), f"file://{tmp_path}/none")


def test_search_by_blocks_of_queries_keeps_the_best_only(spark, tmp_path, monkeypatch):
    """Copies and strings as ids: what tasks give is k rows a query, not the pairs that were compared."""
    points = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    rows = spark.createDataFrame([(f"id{i:03d}", points[i % 3]) for i in range(300)], "chunk_id string, v array<double>").repartition(2)
    index = vector_index.build(rows, f"file://{tmp_path}/many")
    made, real = [], vector_index.written
    monkeypatch.setattr(vector_index, "written", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    asked = rows.where("chunk_id < 'id030'").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    found, told = vector_index.search(asked, index, 4, block=8)
    want = retrieval.search(asked.withColumn("part", F.lit(0)), rows.withColumn("part", F.lit(0)), 4, key="part")
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    near = [df for name, df in made if name == "near"]
    assert len(near) > 1 and sum(df.where("_q IS NOT NULL").count() for df in near) <= 30 * 4 * 3
    assert told.first()["queries"] == 30
