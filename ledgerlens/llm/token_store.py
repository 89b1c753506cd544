"""Token ids in a content-addressed store.

Documents are encoded to ids, each closed by an end id. Where a rolling hash of the last ``WINDOW`` ids ends in zeros the stream is
cut, so that equal passages give equal chunks; a chunk is named by the BLAKE2b digest of its little-endian ids, of 16 bits each if the
vocabulary allows it, else of 32. The store is four
Parquet tables below one path:

    packs      what the encoding tasks wrote, a row per document; deleted once the other tables are there
    chunks     digest, n, data: each different chunk once
    recipes    bucket, seq, doc_id, start, n_tokens, root, digests: documents in ascending doc_id order, bucket by bucket
    manifests  bucket, level, node, hash: Merkle trees over the documents' roots, a bucket each, and, as bucket -1, one over theirs

A document's root is the Merkle root of its chunks' digests. Reading checks every chunk against its name and every document against
its root. CRCs of documents are combined from those of their chunks, so that chunks needn't be put together to verify a document;
``documents`` puts them together.

The order of doc_id is that of range buckets; the driver holds a token count per bucket. Encoding is by tiktoken with the
vocabulary of the tokenizer file: the ids are those of the tokenizers library, at a quarter of its time.

Edge cases: null and empty texts are the end id alone; rows that share id and text follow each other; null ids come first; an empty
table gives empty tables; texts of any length are encoded whole, as rows of at most ``ROW_IDS`` ids' chunks; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPACE, byte_letters
from .common import discard, keyed, partitions, python_batches, table, work_path
from .neighbours import bucket_of, cut_points

END_ID = 2
WINDOW = 8
LEAST, MEAN_BITS, MOST = 64, 8, 1024
FAN = 256
DIGEST = 16
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)

#: The pre-tokeniser's pattern, fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to ids, and the added tokens, of a byte-level tokenizer file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}, added


#: White space from here on is taken out of a text: the pattern's engine backtracks over a run of it and fails on a million.
LONG_RUN = 100_000


class IdEncoder:
    """Ids of whole texts, those of the tokenizers library."""

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int]):
        import tiktoken

        self.ranks, self.added = ranks, added
        self.encoding = tiktoken.Encoding("store", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.single = None
        self.run = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not self.run.search(text):
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [*self.plain(text[at : m.start()]), np.array([self.added[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, *self.plain(text[at:])])

    def plain(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text without added tokens, part by part. A run of white space is one word of its own up to its last character, which goes with what follows."""
        import tiktoken

        at = 0
        for m in self.run.finditer(text):
            yield self.encoding.encode_to_numpy(text[at : m.start()], disallowed_special=())
            at = m.end() if m.end() == len(text) else m.end() - 1
            if self.single is None:
                self.single = tiktoken.Encoding("run", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
            yield self.single.encode_to_numpy(text[m.start() : at])
        yield self.encoding.encode_to_numpy(text[at:], disallowed_special=())


def cut(ids: np.ndarray) -> list[int]:
    """The ends of a document's chunks: where the hash of the last WINDOW ids has MEAN_BITS zeros, at least LEAST and at most MOST ids apart."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * MIX
    rolling = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        rolling = rolling * ODD + (mixed[k : n - WINDOW + 1 + k] ^ (mixed[k : n - WINDOW + 1 + k] >> np.uint64(29)))
    places = np.flatnonzero((rolling >> np.uint64(64 - MEAN_BITS)) == 0) + WINDOW
    ends, at = [], 0
    for p in [*places.tolist(), n]:
        while p - at > MOST:
            at += MOST
            ends.append(at)
        if p - at >= LEAST and p < n:
            at = p
            ends.append(p)
    return [*ends, n] if not ends or ends[-1] < n else ends


def merkle(digests: list[bytes]) -> bytes:
    """The root of a binary hash tree; a lone node goes up as it is."""
    while len(digests) > 1:
        pairs = [hashlib.blake2b(a + b, digest_size=DIGEST).digest() for a, b in zip(digests[::2], digests[1::2], strict=False)]
        digests = pairs + digests[len(pairs) * 2 :]
    return digests[0]


def pack(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode and cut: a row per document with its chunks; a task gives the data of a chunk the first time only."""
    spark = docs.sparkSession
    python_batches(spark)
    ranks, added = vocabulary(tokenizer)
    shared = spark.sparkContext.broadcast((ranks, added))
    width = 2 if max([*ranks.values(), *added.values(), end_id]) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = IdEncoder(*shared.value)
        seen: set[bytes] = set()
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "root": [], "digests": [], "sizes": [], "data": []}
            with np.errstate(over="ignore"):
                for text in batch.column(2).to_pylist():
                    ids = np.append(encode(text), np.uint32(end_id))
                    raw, ends = ids.astype(f"<u{width}").tobytes(), cut(ids)
                    parts = [raw[width * a : width * b] for a, b in zip([0, *ends], ends, strict=False)]
                    digests = [hashlib.blake2b(p, digest_size=DIGEST).digest() for p in parts]
                    out["n_tokens"].append(len(ids))
                    out["root"].append(merkle(digests))
                    out["digests"].append(digests)
                    out["sizes"].append([len(p) // width for p in parts])
                    fresh = []
                    for d, p in zip(digests, parts, strict=True):
                        fresh.append(None if d in seen else p)
                        seen.add(d)
                    out["data"].append(fresh)
                    if len(seen) > 1_000_000:
                        seen.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out["n_tokens"], pa.int64()), pa.array(out["root"], pa.binary()), pa.array(out["digests"], pa.list_(pa.binary())), pa.array(out["sizes"], pa.list_(pa.int32())), pa.array(out["data"], pa.list_(pa.binary()))],
                ["doc_id", "_th", "n_tokens", "root", "digests", "sizes", "data"],
            )

    rows = keyed(docs, "doc_id").select("doc_id", "_th", "_text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, _th bigint, n_tokens bigint, root binary, digests array<binary>, sizes array<int>, data array<binary>")
    made.write.option("compression", "zstd").parquet(f"{path}/packs")


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, _th, n_tokens, ...) with bucket, seq (their number in it) and start (ids before them), by ascending doc_id."""
    cuts = cut_points(rows.select("doc_id"), "doc_id", partitions(rows.sparkSession))
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), cuts))
    sizes = sorted((r["bucket"], r["n"]) for r in rows.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())  # a row per bucket
    base, total = [0] * (len(cuts) + 2), 0
    for b, n in sizes:
        base[b], total = total, total + n
    by = Window.partitionBy("bucket").orderBy("doc_id", "_th")
    before = F.coalesce(F.sum("n_tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = rows.sparkSession.createDataFrame([(b, base[b]) for b, _ in sizes], "bucket int, _base bigint")
    return rows.withColumn("seq", F.row_number().over(by) - 1).withColumn("_before", before).join(F.broadcast(bases), "bucket").withColumn("start", F.col("_base") + F.col("_before")).drop("_base", "_before")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the store below ``path``."""
    spark = docs.sparkSession
    pack(docs, path, tokenizer, end_id)
    packs = spark.read.parquet(f"{path}/packs")
    fresh = packs.select(F.explode(F.arrays_zip("digests", "sizes", "data")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n"), F.col("c.data").alias("data")).where(F.col("data").isNotNull())
    fresh.groupBy("digest").agg(F.first("n").alias("n"), F.first("data").alias("data")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = with_starts(packs.select("doc_id", "_th", "n_tokens", "root", "digests"))
    recipes.select("bucket", "seq", "doc_id", "start", "n_tokens", "root", "digests").write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(spark, path)
    discard(spark, f"{path}/packs")


def level_above(nodes: DataFrame) -> DataFrame:
    """The parents of (bucket, level, node, hash): hashes of up to FAN children in order."""
    up = nodes.groupBy("bucket", "level", F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("_c"))
    return up.select("bucket", (F.col("level") + 1).alias("level"), "node", F.sha2(F.array_join(F.transform("_c", lambda c: F.hex(c["hash"])), ""), 256).alias("_h")).select("bucket", "level", "node", F.unhex("_h").alias("hash"))


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, level, node, hash): Merkle trees over the roots of each bucket's documents in the recipes, up to one node, and over those up to one root of all (bucket -1)."""
    nodes = spark.read.parquet(f"{path}/recipes").select("bucket", F.lit(0).alias("level"), F.col("seq").cast("long").alias("node"), F.col("root").alias("hash"))
    most, buckets = nodes.agg(F.max("node"), F.max("bucket")).first()
    levels = [level_above(nodes)]
    while (most or 0) >= FAN:
        most //= FAN
        levels.append(level_above(levels[-1]))
    top = levels[-1].select(F.lit(-1).alias("bucket"), "level", F.col("bucket").cast("long").alias("node"), "hash")
    levels.append(level_above(top))
    while (buckets or 0) >= FAN:
        buckets //= FAN
        levels.append(level_above(levels[-1]))
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return every


def manifest(spark: SparkSession, path: str) -> None:
    """Write the trees of all buckets."""
    tree(spark, path).write.option("compression", "zstd").parquet(f"{path}/manifests")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Fail unless the recipes give every node of the stored trees and no other, so that none is lost, repeated or replaced."""
    own, stored = tree(spark, path), spark.read.parquet(f"{path}/manifests").withColumnRenamed("hash", "_stored")
    odd = own.join(stored, ["bucket", "level", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("_stored")))
    if (bucket := odd.agg(F.max("bucket").alias("b")).first()["b"]) is not None:
        raise ValueError(f"the recipes of bucket {bucket} don't give its manifest")


def verified_chunks(spark: SparkSession, path: str, data: bool = False) -> DataFrame:
    """digest, n, crc (and data) of all chunks as 32-bit ids, each checked against its name."""
    python_batches(spark)
    names = ["digest", "n", "crc"] + ["data"] * data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, wide = [], []
            for digest, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if hashlib.blake2b(raw, digest_size=DIGEST).digest() != digest or len(raw) not in (2 * n, 4 * n):
                    raise ValueError(f"chunk {digest.hex()} isn't what its name says")
                wide.append(np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) == 2 * n else raw)
                crcs.append(zlib.crc32(wide[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64()), *([pa.array(wide, pa.binary())] if data else [])], names)

    rows = spark.read.parquet(f"{path}/chunks").select("digest", "n", "data")
    return rows.mapInArrow(run, "digest binary, n int, crc bigint" + ", data binary" * data)


POLY = 0xEDB88320


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, bits reflected."""
    out = np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(POLY), np.uint64(0))
    return out


def shifts(most: int) -> np.ndarray:
    """What a CRC is multiplied by when so many 32-bit words, 0 to ``most``, follow."""
    step = np.array([1 << 31], np.uint64)
    for _ in range(32):
        step = (step >> np.uint64(1)) ^ np.where(step & np.uint64(1), np.uint64(POLY), np.uint64(0))
    out = np.empty(most + 1, np.uint64)
    out[0] = 1 << 31
    for i in range(1, most + 1):
        out[i] = times(out[i - 1 : i], step)[0]
    return out


def combined(parts: list[list[dict]], table: np.ndarray) -> np.ndarray:
    """The CRC of each document from its chunks' crc and n, all documents chunk by chunk at once."""
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    out = np.zeros(len(parts), np.uint64)
    for step in range(len(parts[order[0]]) if parts else 0):
        live = [i for i in order if len(parts[i]) > step] if step == 0 or len(parts[order[-1]]) <= step else order
        order = live
        crc = np.array([parts[i][step]["crc"] for i in live], np.uint64)
        n = np.array([parts[i][step]["n"] for i in live])
        out[live] = times(table[n], out[live]) ^ crc
    return out


def checked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: its chunks are there, are what their names say, and give its root and length.

    The recipes are compared with the manifests at once, the rest when rows are read.
    """
    check_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    entries = recipes.select("bucket", "seq", F.posexplode("digests").alias("i", "digest"))
    found = entries.join(verified_chunks(spark, path), "digest", "left")
    per = found.groupBy("bucket", "seq").agg(F.sort_array(F.collect_list(F.struct("i", "digest", "n", "crc"))).alias("parts"))
    rows = recipes.select("bucket", "seq", "doc_id", "start", "n_tokens", "root").join(per, ["bucket", "seq"]).select("doc_id", "start", "n_tokens", "root", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = shifts(MOST)
        for batch in batches:
            parts = batch.column(4).to_pylist()
            for own, n, root in zip(parts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if any(p["n"] is None for p in own) or sum(p["n"] for p in own) != n or merkle([p["digest"] for p in own]) != root:
                    raise ValueError("a document can't be put together from its chunks")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(combined(parts, powers).astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (little-endian 32-bit, in one binary) of every document, put together from its chunks; the recipes are compared with the manifests at once."""
    check_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    entries = recipes.select("bucket", "seq", "doc_id", "start", F.posexplode("digests").alias("i", "digest")).join(verified_chunks(spark, path, data=True), "digest")
    per = entries.groupBy("bucket", "seq", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("i", "data"))).alias("_p"))
    whole: Column = F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["data"])), ""))
    return per.select("doc_id", "start", whole.alias("ids"))


def op8_token_store(spark, sf_dir: str) -> DataFrame:
    """What the store says of every document."""
    path = work_path(spark, "store")
    write(table(spark, sf_dir, "documents"), path)
    return checked(spark, path)
