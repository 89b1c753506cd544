"""The prefix trie against a dictionary of prefixes, with many small shards; LOUDS against its definition; odd turns, empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import prefix_trie
from ledgerlens.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, labels int, path long"


def nodes(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, p in sorted(built.items()):
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1])
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, turns, shards=4):
    df = spark.createDataFrame([(*t, "x", 1, 2) for t in turns], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        return sorted(map(tuple, prefix_trie.trie(prefix_trie.paths(prefix_trie.rebuilt(prefix_trie.labelled(df)))).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def random_turns(seed, conversations, words, most, step=1):
    rng = random.Random(seed)
    out = []
    for c in range(0, conversations * step, step):
        out += [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", rng.choice(words)) for t in range(rng.randrange(1, most))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_louds(seed):
    rng = random.Random(seed)
    parents = [-1]
    for _ in range(rng.randrange(0, 60)):
        parents.append(rng.randrange(max(parents[-1], 0), len(parents)))  # level order: never before the one before
    degrees = np.array([parents.count(i) for i in range(len(parents))])
    tree = prefix_trie.Louds(degrees)
    assert "".join(map(str, tree.bits.astype(int))) == "10" + "".join("1" * k + "0" for k in degrees)
    assert tree.parents().tolist() == parents


def test_query_against_dictionary(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, sf).collect()), key=str) == nodes(turns)


@pytest.mark.parametrize("shards", [1, 3, 17])
def test_many_shards_and_rounds(spark, monkeypatch, shards):
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    turns = random_turns(shards, 150, ["", "a", "bb", "a\x00b"], 9)
    assert found(spark, turns, shards) == nodes(turns)


def test_copies_in_several_shards(spark, monkeypatch):
    """One conversation makes up most rows and ends in several shards; its list of ids comes in order, in stretches."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    monkeypatch.setattr(prefix_trie, "FAN", 3)
    turns = [(c, t, "user", w) for c in range(300) for t, w in enumerate(["same", "words", "here"])] + random_turns(1, 40, ["same", "words", "x"], 6, step=50)
    assert found(spark, turns, 8) == nodes(turns)


def test_deep_and_odd(spark):
    turns = [(7, t, "user", f"t{t % 3}") for t in range(700)] + [(8, t, "user", f"t{t % 3}") for t in range(701)]
    turns += [(-5, None, None, None), (-5, None, "", ""), (-5, 2, "a", None), (None, 1, "user", "nobody"), (300, 0, "user", "é😀" * 9), (301, 0, "user", "é😀" * 9), (301, 0, "user", "é😀" * 9), (302, 4, "user", "x" * 70_000)]
    assert found(spark, turns) == nodes(turns)


def test_turnless(spark):
    lonely = next(c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6)
    assert found(spark, [(lonely, 0, "user", "gone")]) == nodes([(lonely, 0, "user", "gone")]) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


def test_no_conversation(spark):
    assert found(spark, []) == found(spark, [(None, 0, "user", "a")]) == []
