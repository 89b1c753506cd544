"""Recall of links, measured against all pairs in plain Python: five-word shingle similarity of 0.8 or more, in small buckets and in crowded ones."""

import numpy as np
import pytest

from ledgerlens.llm import near_dup


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def changed(words, random, share):
    out = list(words)
    for p in random.choice(len(out), max(1, int(share * len(out))), replace=False):
        kind = random.integers(3)
        out[p] = f"e{random.integers(10**6)}" if kind == 0 else "" if kind == 1 else f"{out[p]} i{random.integers(10**6)}"
    return " ".join(w for w in out if w).split()


def unlike(random):
    """Texts of their own, each with copies at several distances."""
    for _ in range(120):
        base = [f"w{x}" for x in random.integers(0, 20_000, random.integers(30, 300))]
        yield base
        for share in (0.01, 0.02, 0.04, 0.08):
            yield changed(base, random, share)


def forms(random):
    """One form filled in 200 times: three quarters of the words are in all of them; and changed copies of each."""
    head, middle, tail = ([f"c{k}x{x}" for x in range(40)] for k in range(3))
    for _ in range(200):
        own = [[f"o{x}" for x in random.integers(0, 20_000, 20)] for _ in range(2)]
        base = [*head, *own[0], *middle, *own[1], *tail]
        yield base
        yield changed(base, random, 0.02)


def boilerplate(random):
    """A long passage that 250 otherwise unlike texts share, and changed copies of some."""
    passage = [f"p{x}" for x in range(60)]
    for i in range(250):
        own = [f"q{x}" for x in random.integers(0, 50_000, 40)]
        yield [*own, *passage]
        if i % 3 == 0:
            yield changed([*own, *passage], random, 0.02)


@pytest.mark.parametrize("kind", [unlike, forms, boilerplate])
def test_recall_against_all_pairs(spark, kind):
    random = np.random.default_rng(11)
    texts = list(kind(random))
    sets = [shingles(w) for w in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    code = {w: k for k, w in enumerate({w for t in texts for w in t})}
    coded = [np.array([code[w] for w in t]) for t in texts]
    good = near_dup.alike([(coded[i], coded[j]) for i, j in pairs])
    links = [p for p, g in zip(pairs, good, strict=True) if g]
    found = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert len(links) > 50
    assert np.mean([found[i] == found[j] for i, j in links]) >= 0.99
