"""Near duplicates in crowded buckets: links between texts that share few of their shingles."""

import numpy as np

from ledgerlens.llm import near_dup


def test_links_in_crowded_buckets_whatever_the_shingles(spark):
    """Texts around one passage, in pairs whose own words differ in every third place, so that they share the passage's shingles only, as all texts do: pairs that share a sample are linked."""
    random = np.random.default_rng(12)
    passage = [f"p{x}" for x in random.integers(0, 5000, 45)]
    rows = {}
    for i in range(200):
        own = [f"u{x}" for x in random.integers(0, 10**6, 35)]
        rows[2 * i], rows[2 * i + 1] = passage + own, passage + [f"v{i}x{k}" if k % 3 == 1 else w for k, w in enumerate(own)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string").repartition(4)
    samples = {r["id"]: set(r["samples"]) for r in near_dup.sketches(docs.withColumnRenamed("doc_id", "id")).collect()}
    met = [i for i in range(0, 400, 2) if samples[i] & samples[i + 1]]
    found = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    assert len(met) > 50 and all(found[i] == found[i + 1] == i for i in met)
    assert all(found[i] in (i, i - i % 2) for i in rows)


def test_aligned_texts_share_a_rarest_word():
    random = np.random.default_rng(13)
    seen = random.integers(0, 50, near_dup.PLACES[0] * near_dup.PLACES[1]).astype(float)
    chosen, pairs = near_dup.rarest(seen, 0.8), []
    for _ in range(400):
        a = random.integers(0, 30, random.integers(1, 80))
        b = [x for x in a.tolist() if random.random() > 0.1]
        for _ in range(random.integers(0, 9)):
            b.insert(random.integers(0, len(b) + 1), int(random.integers(0, 30)))
        if b:
            pairs.append((a, np.array(b, np.int64)))
    good = near_dup.alike(pairs)
    with np.errstate(over="ignore"):
        assert all(set(chosen(a).tolist()) & set(chosen(b).tolist()) for (a, b), g in zip(pairs, good, strict=True) if g) and good.sum() > 100


def test_each_pair_meets_once_in_settling_rounds(spark, monkeypatch):
    """Texts that share a passage and many of their rarest words, half of them in classes of their own: no pair is aligned twice or within a class, and classes are looked up for each node and bucket once, whatever the rounds."""
    random = np.random.default_rng(14)
    passage, pool = [f"p{x}" for x in random.integers(0, 5000, 45)], [f"u{x}" for x in range(60)]
    texts = [passage + list(random.permutation(pool)[:35]) for _ in range(60)]
    rows = texts + [t[:-1] + [f"e{i}"] for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    looked, met, orders = [], [], []
    classed, pairs, order = near_dup.classed, near_dup.settling_pairs, near_dup.hub_order
    monkeypatch.setattr(near_dup, "classed", lambda rows, roots: looked.append(1) or classed(rows, roots))
    monkeypatch.setattr(near_dup, "hub_order", lambda rows: orders.append(order(rows)) or orders[-1])
    monkeypatch.setattr(near_dup, "settling_pairs", lambda *a: met.append(near_dup.saved(pairs(*a), "met")) or met[-1])
    found = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    seen = [tuple(r) for m in met for r in m.collect()]
    assert all(found[i] == found[i + 60] for i in range(60)) and len(set(found.values())) > 10
    assert len(looked) == 2 and len(met) > 1 and len(orders) == 1
    assert len(seen) == len(set(seen)) > 100
