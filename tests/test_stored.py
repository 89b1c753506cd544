"""CSV files against csv.DictReader, batch and stream; stored blobs put, read in chunks, replaced, damaged and deleted."""

import csv
import hashlib
import io
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import blobs, readers, upserts

CELLS = ["Shop", "Shop, \"The\" Best", "two\nlines", "a\r\nb\n\nc", "", "  padded ", "é漢😀", "quote\"", "'", "x" * 200_000]


def random_csv(seed):
    rng = random.Random(seed)
    names = ["date", "Amount ", "TYPE", rng.choice(["merchant", " Description"])] + rng.sample(["timestamp", "note", "merchant", "id"], rng.randrange(0, 3))
    names = list(dict.fromkeys(n.lower() if rng.random() < 0.5 else n for n in names))
    rng.shuffle(names)
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(names)
    for _ in range(rng.randrange(0, 40)):
        row = [{"amount": rng.choice(["1.5", "-2", " 3 ", "oops", "nan", "1e3", "1_000", ""]), "type": rng.choice(["debit", "CREDIT ", "other", ""]), "date": rng.choice(["2026-01-01", "x\ny"])}.get(n.lower().strip(), rng.choice(CELLS)) for n in names]
        if rng.random() < 0.1:
            row = row[:-1] if rng.random() < 0.5 else [*row, "more"]
        writer.writerow(row)
        if rng.random() < 0.1:
            out.write("\n")
    return out.getvalue()


def dict_rows(text):
    csv.field_size_limit(10**9)
    out = []
    for seq, row in enumerate(csv.DictReader(io.StringIO(text, newline=""))):
        if None in row or None in row.values():
            continue
        row = {k.lower().strip(): v.strip() for k, v in row.items()}
        try:
            amount = float(row["amount"])
        except ValueError:
            continue
        if row["type"].lower() in ("debit", "credit") and math.isfinite(amount):
            out.append((seq, row["date"], amount, row["type"].lower(), row.get("merchant") or row.get("description") or "UNKNOWN", row.get("timestamp")))
    return out


@pytest.fixture
def folder(tmp_path):
    texts = {f"{i}.csv": random_csv(i) for i in range(12)}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes((b"\xef\xbb\xbf" if name < "3" else b"") + text.encode())
    return tmp_path, {(name, *r) for name, text in texts.items() for r in dict_rows(text)}


def told(rows):
    return {(os.path.basename(r["file"]), r["seq"], r["date"], r["amount"], r["type"], r["merchant"], r["timestamp"]) for r in rows}


def test_csv_equals_dict_reader(spark, folder):
    path, want = folder
    rows = readers.transactions_csv(spark, f"file://{path}/in").collect()
    assert told(rows) == want and len(rows) == len(want) > 50


def test_csv_as_a_stream(spark, folder):
    path, want = folder
    (path / "in" / "bad.csv").write_text("date,amount\n1,2\n")
    got = []
    rows = readers.transactions_csv_stream(spark, f"file://{path}/in", files_at_once=5)
    rows.writeStream.option("checkpointLocation", f"file://{path}/c").foreachBatch(lambda df, _: got.append(df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert len(got) == 3 and told(r for lot in got for r in lot) == want


def test_broken_csv(spark, tmp_path):
    for name, content in {"a.csv": b"date,amount,type,merchant\n2026-01-01,1,debit,\xff\xfe\n", "e.csv": b"", "b.csv": b"\n", "c.csv": b"date,amount,type\n", "d.csv": b"date,amount,type,merchant\n2026-01-01,1,debit,x\n"}.items():
        (tmp_path / name).write_bytes(content)
    rows = {os.path.basename(r["file"]): r for r in readers.csv_rows(spark.read.format("binaryFile").load(f"file://{tmp_path}")).collect()}
    assert "UTF-8" in rows["a.csv"]["error"] and "missing" in rows["b.csv"]["error"] and "merchant" in rows["c.csv"]["error"] and rows["d.csv"]["error"] is None and "e.csv" not in rows
    with pytest.raises(ValueError, match="needed|missing|UTF-8"):
        readers.transactions_csv(spark, f"file://{tmp_path}")


BLOB = "blob_id string, name string, content binary, owner int, length string"


def contents(spark, path, ids=None):
    rows = blobs.get(spark, path, ids).collect()
    out = {}
    for r in rows:
        out.setdefault(r["blob_id"], []).append((r["chunk_no"], bytes(r["data"]), r["chunks"]))
    assert all([c[0] for c in v] == list(range(v[0][2])) for v in out.values())
    return {k: b"".join(c[1] for c in v) for k, v in out.items()}


def test_blobs(spark, tmp_path):
    path = f"file://{tmp_path}/blobs"
    bodies = {"a": os.urandom(100_000), "b": b"short", "c": b"", "d": b"x" * 4096, "e": os.urandom(12_289)}
    rows = spark.createDataFrame([(k, f"{k}.pdf", v, 7) for k, v in bodies.items()] + [("b", "a first by name", b"other", 7), (None, "none", b"z", 7), ("f", "null", None, 7)], BLOB.replace(", length string", ""))
    blobs.put(rows, path, "2026-01-01", chunk=4096, batch=0)
    blobs.put(rows.withColumn("content", F.lit(b"replayed")), path, "2026-01-09", chunk=4096, batch=0)
    assert contents(spark, path) == {k: v for k, v in bodies.items() if v}
    facts = {r["blob_id"]: (r["name"], r["length"], r["chunks"], r["sha256"], r["owner"]) for r in blobs.info(spark, path).collect()}
    assert facts == {k: (f"{k}.pdf", len(v), -(-len(v) // 4096), hashlib.sha256(v).hexdigest(), 7) for k, v in bodies.items()} | {"f": ("null", 0, 0, hashlib.sha256(b"").hexdigest(), 7)}
    blobs.put(spark.createDataFrame([("a", "a2.pdf", b"new" * 3000, 8)], BLOB.replace(", length string", "")), path, "2026-01-02", chunk=4096)
    asked = spark.createDataFrame([("a",), ("none",), ("a",)], "blob_id string")
    assert contents(spark, path, asked) == {"a": b"new" * 3000}
    assert {r["blob_id"]: (r["found"], r["name"]) for r in blobs.info(spark, path, asked).collect()} == {"a": (True, "a2.pdf"), "none": (False, None)}
    blobs.delete(spark.createDataFrame([(k,) for k in ["a", "b", "zz"]], "blob_id string"), path)
    assert sorted(contents(spark, path)) == ["d", "e"] and blobs.info(spark, path).count() == 4
    assert blobs.vacuum(spark, path) == 1 and sorted(contents(spark, path)) == ["d", "e"]
    blobs.delete(blobs.info(spark, path), path)
    assert blobs.info(spark, path).count() == 0 and contents(spark, path) == {} and blobs.vacuum(spark, path) == 1


def test_damaged_blobs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "a", b"0123456789" * 10)], "blob_id string, name string, content binary")
    damages = [lambda p: p.where("chunk_no <> 2"), lambda p: p.where("chunk_no < 9"), lambda p: p.withColumn("data", F.when(F.col("chunk_no") == 1, F.lit(b"odd")).otherwise(F.col("data"))), lambda p: p.unionByName(p.where("chunk_no = 1")), lambda p: p.withColumn("data", F.when(F.col("chunk_no") == 1, F.lit(b"odd")).otherwise(F.col("data"))).withColumn("sha256", F.sha2("data", 256))]
    for i, damage in enumerate(damages):
        path = f"file://{tmp_path}/{i}"
        blobs.put(rows, path, "x", chunk=10)
        place = next((tmp_path / str(i) / "chunks").iterdir())
        parts = damage(spark.read.parquet(f"file://{place}"))
        parts.write.parquet(f"file://{place}-new")
        for f in place.glob("*.parquet"):
            f.unlink()
        for f in list(place.glob(".*")) + list(place.glob("_*")):
            f.unlink()
        for f in (place.parent / f"{place.name}-new").glob("*.parquet"):
            f.rename(place / f.name)
        assert blobs.info(spark, path).count() == 1
        with pytest.raises(Exception, match="lost, repeated or damaged|put together"):
            blobs.get(spark, path).collect()


def test_delete_empties_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    upserts.upsert(rows, path, ["k"], "at", buckets=2)
    upserts.delete(rows.where("k = 1"), path, ["k"], buckets=2)
    assert [r["k"] for r in upserts.current(spark, path).collect()] == [2]
    upserts.delete(rows, path, ["k"], buckets=2)
    assert upserts.current(spark, path).collect() == [] and upserts.current(spark, path).columns == ["k", "v", "at"]
    upserts.upsert(rows, path, ["k"], "at", buckets=2)
    assert upserts.current(spark, path).count() == 2
