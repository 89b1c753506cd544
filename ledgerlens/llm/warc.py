"""WARC archives as a chunked record table.

Writing: every record becomes rows of (record, chunk number, at most ``CHUNK`` bytes), dealt and sorted by record, and a task writes
its rows to gzip'd WARC files as they come, one member per record. Reading: a task streams a file and gives the same kind of rows,
each with the bytes, length and SHA-1 so far; the last row of a record has those of the whole payload, checked against the header.
Neither holds more than a chunk of a record.

Of records with equal payloads of at least ``min_bytes`` the one with the least page_id is written whole, the others as revisits
that name it. Payloads are compared by length and SHA-1; the search for firsts moves digests only. Files get names of their own in
each attempt of a task and count only if the attempt's row comes back, so that lost executors and repeated tasks leave no half
archives.

Edge cases: null payloads are empty; rows that share id and payload are both written as what the first would be; null ids come
after all others as firsts, and refer to nothing; an empty table gives no files and no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_batches, table, work_path

CHUNK = 256 << 10
#: A file is closed, and another begun, at the first record's end beyond so many bytes.
FILE_BYTES = 1 << 30
READ = 1 << 20
URN = "urn:page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, _payload, _sha1 (hex), _refers (null for what is written whole)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("_payload")).withColumn("_sha1", F.sha1("_payload"))
    small = rows.where(F.octet_length("_payload") >= min_bytes).select("page_id", "_sha1", F.octet_length("_payload").alias("_size"))
    firsts = small.groupBy("_sha1", "_size").agg(F.min("page_id").alias("_refers"))
    again = small.join(firsts, ["_sha1", "_size"]).where(F.col("page_id").isNull() | (F.col("page_id") > F.col("_refers"))).where(F.col("_refers").isNotNull())
    again = again.select(F.col("page_id").alias("_id"), F.col("_sha1").alias("_own"), "_refers").distinct()
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha1") == F.col("_own")), "left")
    return joined.select("page_id", "url", "_payload", "_sha1", "_refers")


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (record, chunk_no, chunks, data) of what ``records`` gives; a revisit has one empty chunk."""
    size = F.octet_length("_payload")
    whole = F.col("_refers").isNull()
    count = F.when(whole, F.greatest(F.lit(1), F.ceil(size / chunk))).otherwise(1).cast("int")
    spread = rows.select("*", size.cast("long").alias("size"), count.alias("chunks"), F.monotonically_increasing_id().alias("record"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    data = F.when(whole, F.substring("_payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return spread.select("record", "chunk_no", "chunks", F.col("page_id").cast("string").alias("page"), "url", "size", F.col("_sha1").alias("sha1"), F.col("_refers").cast("string").alias("refers"), data.alias("data"))


def header(page: str | None, url: str | None, size: int, sha1: str, refers: str | None, now: str) -> bytes:
    body = HTTP.format(size).encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page is None else page}>",
        f"WARC-Date: {now}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body) + (size if refers is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body


def write(pages: DataFrame, path: str, min_bytes: int = 0, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> list[str]:
    """Write the archives below ``path``; the URIs of their files."""
    spark = pages.sparkSession
    python_batches(spark)
    rows = chunked(records(pages, min_bytes), chunk)  # chunks of a record are made, and stay, in one partition and in order
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        out, name, packer = None, "", None
        for batch in batches:
            columns = [batch.column(c) for c in ("chunk_no", "chunks", "page", "url", "size", "sha1", "refers", "data")]
            for no, count, page, url, size, sha1, refers, data in zip(*(c.to_pylist() for c in columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                if no == 0:
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    out.write(packer.compress(header(page, url, size, sha1, refers, now)))
                out.write(packer.compress(data))
                if no == count - 1:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    if out.tell() >= file_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"]})

    return sorted(r["file"] for r in rows.mapInArrow(run, "file string").collect())  # a name per file


class Unpacked:
    """The bytes of a file of gzip members, read in pieces."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.unpacker, self.raw, self.buffer = source, zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        if self.unpacker.eof:
            self.raw, self.unpacker = self.unpacker.unused_data or self.raw, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.source.read(READ)
            if not self.raw:
                return False
        self.buffer += self.unpacker.decompress(self.raw, READ)
        self.raw = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before ``mark``, which is dropped; empty at the end."""
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                return b""
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size and self.more():
            pass
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        if len(out) < size:
            raise ValueError("a record is cut off")
        return out


def record_rows(source: pa.NativeFile, chunk: int = CHUNK) -> Iterator[tuple]:
    """(page, type, refers, chunk_no, last, data, bytes so far, base32 SHA-1 so far, payload's bytes, its base32 SHA-1) of all records of a file.

    The last two are what the record's headers say, which for a revisit is all there is of the payload.
    """
    stream = Unpacked(source)
    while head := stream.until(b"\r\n\r\n"):
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        left = int(fields["Content-Length"])
        http = stream.until(b"\r\n\r\n")
        left -= len(http) + 4
        whole = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page, refers = (fields.get(f, "").removeprefix(f"<{URN}").removesuffix(">") or None for f in ("WARC-Record-ID", "WARC-Refers-To"))
        digest, size, no = hashlib.sha1(), 0, 0
        while True:
            data = stream.take(min(left, chunk))
            left -= len(data)
            size += len(data)
            digest.update(data)
            if left == 0 and fields["WARC-Type"] == "response" and whole != (size, base64.b32encode(digest.digest()).decode()):
                raise ValueError(f"the payload of {page} isn't what its digest says")
            yield page, fields["WARC-Type"], refers, no, left == 0, data, size, base64.b32encode(digest.digest()).decode(), *whole
            no += 1
            if left == 0:
                break
        stream.take(4)


SCHEMA = "page string, record_type string, refers string, chunk_no int, last boolean, data binary, bytes bigint, digest string, payload_bytes bigint, payload_digest string"


def read(spark: SparkSession, files: list[str], chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of archives; without ``data`` only the last row of each record, with its length and digest."""
    python_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, name = opened(uri)
                with store.open_input_stream(name, compression=None) as source:
                    rows, held = [], 0
                    for row in record_rows(source, chunk):
                        if data or row[4]:
                            rows.append(row if data else (*row[:5], None, *row[6:]))
                            held += len(row[5]) if data else 200
                        if held >= 4 * CHUNK:
                            yield made(rows)
                            rows, held = [], 0
                    if rows:
                        yield made(rows)

    names = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, file string")
    dealt = names.repartitionByRange(max(1, len(files)), "i").select("file") if len(files) > 1 else names.select("file")
    return dealt.mapInArrow(run, SCHEMA)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record, as it is read back from the archives."""
    pages = table(spark, sf_dir, "pages")
    files = write(pages, work_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    found = read(spark, files, data=False)
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))
