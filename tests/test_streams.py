"""The stateful detector against the batch one, and tables that survive replays, dead writers and two writers at once."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import scoring
from ledgerlens.sources import upserts
from ledgerlens.streaming import takeover

TX = "statement_id long, seq long, ts timestamp, type string, merchant string, description string, latest string"
NAMES = ["ATM Withdrawal", "Wire Transfer Intl", "Grocery", "Unknown Transfer", None, "Cash withdrawal fee"]


def transactions(seed, accounts=25, most=14):
    rng, out, at = random.Random(seed), [], datetime(2026, 1, 1, tzinfo=UTC)
    for seq in range(accounts * most):
        at += timedelta(seconds=rng.randrange(0, 60), microseconds=rng.randrange(10**6))
        out.append((rng.randrange(accounts), seq, at, rng.choice(["debit", "debit", "Debit", "CREDIT", None]), rng.choice(NAMES), rng.choice(["", "international", None]), "x"))
    return out


def streamed(spark, tmp_path, lots, **options):
    """What the detector tells of lots of rows that come one after another."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", takeover.ROCKS)
    source, told = tmp_path / "in", []
    for i, lot in enumerate(lots):
        spark.createDataFrame(lot, TX).coalesce(1).write.mode("append").parquet(f"file://{source}/{i:03d}")
    rows = spark.readStream.schema(TX).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{source}")
    keep = lambda df, _: told.append([tuple(r) for r in df.collect()])
    takeover.takeover_stream(rows, **options).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return told


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, tmp_path, shuffled):
    rows = transactions(int(shuffled))
    if shuffled:  # late by at most 30 minutes
        rng = random.Random(1)
        rows.sort(key=lambda r: r[2] + timedelta(minutes=rng.uniform(0, 30)))
    told = streamed(spark, tmp_path, [rows[i : i + 90] for i in range(0, len(rows), 90)], late="1 hour")
    last = {r[0]: r for lot in told for r in lot}
    want = {r["statement_id"]: r["takeover_score"] for r in scoring.takeover(spark.createDataFrame(rows, TX).drop("ts")).collect()}
    assert {k: r[1] for k, r in last.items()} == want and {*want.values()} > {0.0}
    assert {k: r[2] for k, r in last.items()} == {k: sum(r[0] == k for r in rows) for k in want}
    assert any(r[1] != last[r[0]][1] for lot in told for r in lot)  # alerts came before the end


def test_idle_accounts_are_forgotten(spark, tmp_path):
    at = datetime(2026, 1, 1, tzinfo=UTC)
    lots = [[(1, 0, at, "credit", "Salary", None, "x"), (None, 1, at, "debit", "ATM", None, "x"), (1, None, at, "debit", "ATM", None, "x"), (1, 7, None, "debit", "ATM", None, "x")]]
    lots += [[(2, i, at + timedelta(days=i), "debit", "Shop", None, "x")] for i in range(1, 6)]
    lots.append([(1, 9, at + timedelta(days=6), "debit", "ATM", None, "x")])
    told = [r[:3] for lot in streamed(spark, tmp_path, lots, late="1 minute", idle="2 days") for r in lot]
    assert [r for r in told if r[0] == 1] == [(1, 0.0, 1), (1, 0.0, 1)]  # the second time it begins anew
    assert [r[2] for r in told if r[0] == 2] == [1, 2, 3, 4, 5]


ROW = "k long, part string, at int, v string, n int"


def put(spark, rows, path, batch=None, stream="s"):
    return upserts.upsert(spark.createDataFrame(rows, ROW), path, ["k", "part"], "at", stream, batch, buckets=4)


def content(spark, path):
    return sorted(map(str, map(tuple, upserts.current(spark, path).collect())))


def test_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(ValueError, match="nothing"):
        upserts.current(spark, path)
    assert put(spark, [(1, "a", 1, "x", 1), (1, "a", 2, "y", 1), (1, None, 1, "z", 1), (None, "a", None, "w", None), (2, "b", 5, "v", 9)], path, 0)
    first = content(spark, path)
    assert first == sorted(map(str, [(1, "a", 2, "y", 1), (1, None, 1, "z", 1), (None, "a", None, "w", None), (2, "b", 5, "v", 9)]))
    assert not put(spark, [(1, "a", 9, "replayed otherwise", 1)], path, 0) and content(spark, path) == first
    assert put(spark, [(1, "a", 1, "older", 1), (2, "b", 6, "newer", 9), (3, "c", 1, "new", 0)], path, 1)
    assert content(spark, path) == sorted(map(str, [(1, "a", 2, "y", 1), (1, None, 1, "z", 1), (None, "a", None, "w", None), (2, "b", 6, "newer", 9), (3, "c", 1, "new", 0)]))
    assert put(spark, [(3, "c", 2, "other stream", 0)], path, 0, stream="t") and put(spark, [], path, 2) and not put(spark, [], path, 2)
    assert "other stream" in " ".join(content(spark, path))
    before = content(spark, path)
    upserts.vacuum(spark, path)
    assert content(spark, path) == before and upserts.vacuum(spark, path) == 0


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    put(spark, [(1, "a", 1, "x", 1)], path, 0)
    before = content(spark, path)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(upserts, "commit", die)
        with pytest.raises(KeyboardInterrupt):
            put(spark, [(1, "a", 2, "half", 1), (5, "a", 2, "half", 1)], path, 1)
    assert content(spark, path) == before
    assert put(spark, [(1, "a", 2, "whole", 1)], path, 1) and content(spark, path) == [str((1, "a", 2, "whole", 1))]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    put(spark, [(1, "a", 1, "x", 1)], path, 0)
    real = upserts.commit

    def overtaken(session, where, state):
        monkeypatch.setattr(upserts, "commit", real)
        put(spark, [(2, "b", 1, "faster", 1)], path, 0, stream="other")
        real(session, where, state)

    monkeypatch.setattr(upserts, "commit", overtaken)
    with pytest.raises(RuntimeError, match="another writer"):
        put(spark, [(1, "a", 2, "slower", 1)], path, 1)
    real_last = upserts.last_commit
    stale = real_last(spark, path) | {"generation": 1}
    monkeypatch.setattr(upserts, "last_commit", lambda *_: stale)  # one that has read the table before the other's commit and writes after it
    with pytest.raises(RuntimeError, match="another writer"):
        put(spark, [(2, "b", 9, "too late", 1)], path, 7)
    monkeypatch.setattr(upserts, "last_commit", real_last)
    assert content(spark, path) == sorted(map(str, [(1, "a", 1, "x", 1), (2, "b", 1, "faster", 1)]))


def test_insert_unique(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    insert = lambda rows, batch: upserts.insert_unique(spark.createDataFrame(rows, ROW), path, ["k"], "s", batch, "at", buckets=3)
    assert insert([(1, "a", 2, "late", 1), (1, "a", 1, "first", 1), (None, "a", 1, "none", 1)], 0) and not insert([(9, "a", 1, "x", 1)], 0)
    assert insert([(1, "a", 0, "again", 1), (2, "b", 1, "new", 1), (None, "b", 1, "none again", 1), (2, "b", 1, "new", 1)], 1)
    assert content(spark, path) == sorted(map(str, [(1, "a", 1, "first", 1), (None, "a", 1, "none", 1), (2, "b", 1, "new", 1)]))
    refused = sorted(((r["k"] or 0, r["_batch"], r["reason"], r["rows"]) for r in upserts.conflicts(spark, path).collect()))
    assert refused == [(0, 1, "exists", 1), (1, 0, "repeated", 1), (1, 1, "exists", 1), (2, 1, "repeated", 1)]
    with pytest.raises(ValueError, match="buckets"):
        upserts.insert_unique(spark.createDataFrame([(1, "a", 0, "again", 1)], ROW), path, ["k"], "s", 7, buckets=5)


def test_upserts_of_a_stream(spark, tmp_path):
    rows = [(i % 7, "p", i, f"v{i}", 0) for i in range(60)]
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], ROW).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    path = f"file://{tmp_path}/t"
    for attempt in range(2):  # with a new checkpoint all batches come again
        read = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
        read.writeStream.option("checkpointLocation", f"file://{tmp_path}/c{attempt}").foreachBatch(upserts.sink(path, ["k"], "at", "s", 2)).trigger(availableNow=True).start().awaitTermination()
        assert upserts.current(spark, path).count() == 7 and upserts.current(spark, path).agg(F.sum("at")).first()[0] == sum(range(53, 60))
    assert len(upserts.commits(spark, path)) == 3
