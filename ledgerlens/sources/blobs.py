"""Stored files as a chunked table: put, info, get and delete of many blobs at once, none of which is held whole when it is read.

A put writes rows of (blob_id, chunk_no, data, sha256), ``CHUNK`` bytes each, to a folder of its own, and then names them in a keyed
table of one row a blob (name, length, chunks, the digest of the whole, the put), which is what counts: chunks that it doesn't name, of
a put that died or of a blob that was put again or deleted, are never read, and go with ``vacuum``. Reading streams each blob's chunks in
order, checks every one against its digest and the blob against length, number and digest, by a running hash.

Of rows with one id in a put the greatest by name and digest counts; rows without id are not taken; null contents are empty, and an
empty blob has no chunks. A blob that is put again is replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.batches import bounded
from ledgerlens.functions.storage import discard

from . import upserts

CHUNK = 255 << 10
KEY = ["blob_id"]


def put(rows: DataFrame, path: str, stamp: str, chunk: int = CHUNK, batch: int | None = None) -> None:
    """Store ``rows`` (blob_id, name, content, and what else is to be told of a blob), uploaded at ``stamp``. A ``batch`` that was put before changes nothing."""
    spark = rows.sparkSession
    if upserts.applied(upserts.last_commit(spark, f"{path}/files"), "put", batch):
        return
    lot, more = uuid.uuid4().hex, [c for c in rows.columns if c not in ("blob_id", "name", "content")]
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    named = rows.where(F.col("blob_id").isNotNull()).select(F.col("blob_id").cast("string").alias("blob_id"), F.col("name").cast("string").alias("name"), content.alias("content"), *more).withColumn("sha256", F.sha2("content", 256))
    one = named.groupBy("blob_id").agg(F.max_by(F.struct("name", "content", "sha256", *more), F.struct("name", "sha256")).alias("r")).select("blob_id", "r.*")
    one = one.withColumn("length", F.octet_length("content").cast("long")).withColumn("chunks", F.ceil(F.col("length") / chunk).cast("int"))
    # the whole goes beside the chunks' own rows, as a row without data, so that contents are cut and digested in one pass
    parts = F.when(F.col("chunks") > 0, F.sequence(F.lit(-1), F.col("chunks") - 1)).otherwise(F.array(F.lit(-1)))
    cut = one.withColumn("chunk_no", F.explode(parts)).withColumn("data", F.when(F.col("chunk_no") >= 0, F.substring("content", F.col("chunk_no") * chunk + 1, F.lit(chunk))))
    whole = F.struct("name", "length", "chunks", "sha256", *more)
    place = f"{path}/chunks/put={lot}"
    cut.select("blob_id", "chunk_no", "data", F.when(F.col("chunk_no") < 0, whole).alias("file"), F.sha2("data", 256).alias("sha256")).write.option("compression", "zstd").parquet(place)
    told = spark.read.parquet(place).where("chunk_no < 0").select("blob_id", "file.*").withColumn("put", F.lit(lot)).withColumn("uploaded_at", F.lit(stamp))
    upserts.upsert(told, f"{path}/files", KEY, "uploaded_at", "put", batch)


def info(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """blob_id, name, length, chunks, sha256, uploaded_at and what else was told of all blobs; or found, and these, of the blobs of ``ids``."""
    files = upserts.current(spark, f"{path}/files").drop("put")
    if ids is None:
        return files
    asked = ids.select(F.col("blob_id").cast("string").alias("blob_id")).distinct()
    return asked.join(files, "blob_id", "left").withColumn("found", F.col("sha256").isNotNull())


def delete(ids: DataFrame, path: str) -> None:
    """Forget the blobs of ``ids``; ids that aren't there are no error."""
    upserts.delete(ids.select(F.col("blob_id").cast("string").alias("blob_id")), f"{path}/files", KEY)


def get(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(blob_id, chunk_no, chunks, data): the chunks of all blobs, or of those of ``ids``, each blob's in order within a partition, checked as they go by."""
    bounded(spark)
    files = upserts.current(spark, f"{path}/files").select("blob_id", "put", "length", "chunks", F.col("sha256").alias("whole")).where("chunks > 0")
    if ids is not None:
        files = files.join(ids.select(F.col("blob_id").cast("string").alias("blob_id")).distinct(), "blob_id", "left_semi")
    lots = [f"{path}/chunks/put={r['put']}" for r in files.select("put").distinct().collect()]  # as many as there were puts
    kinds = "blob_id string, chunk_no int, chunks int, data binary"
    if not lots:
        return spark.createDataFrame([], kinds)
    parts = spark.read.option("basePath", f"{path}/chunks").parquet(*lots).where("chunk_no >= 0").select("blob_id", "put", "chunk_no", "data", "sha256")
    joined = files.join(parts, ["blob_id", "put"], "left").select("blob_id", "chunk_no", "chunks", "data", "sha256", "length", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, state, size, seen, due = None, None, 0, 0, (0, 0, "")

        def finished() -> None:
            if blob is not None and (seen, size, state.hexdigest()) != due:
                raise ValueError(f"blob {blob} can't be put together from its chunks")

        for b in batches:
            for own, no, chunks, data, digest, length, whole in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if own != blob:
                    finished()
                    blob, state, size, seen, due = own, hashlib.sha256(), 0, 0, (chunks, length, whole)
                if no != seen or data is None or hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"chunk {seen} of blob {blob} is lost, repeated or damaged")
                state.update(data)
                size, seen = size + len(data), seen + 1
            yield b.select([0, 1, 2, 3])
        finished()

    return joined.repartition("blob_id").sortWithinPartitions("blob_id", F.asc_nulls_first("chunk_no")).mapInArrow(run, kinds)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the puts that no blob needs any more; how many. Not while a writer or reader is at work."""
    needed = {r["put"] for r in upserts.current(spark, f"{path}/files").select("put").distinct().collect()}
    place, fs = upserts.folder(spark, f"{path}/chunks")
    gone = [f.getPath() for f in fs.listStatus(place) if f.getPath().getName().partition("=")[2] not in needed]
    for f in gone:
        discard(spark, f.toString())
    return len(gone)
