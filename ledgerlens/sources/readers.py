"""Sources and sinks: transaction and training CSV, binary files, text store, vector index."""

from __future__ import annotations

import csv
import io
import math
import sys
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.batches import bounded
from ledgerlens.functions.storage import discard, written
from ledgerlens.functions.text import blank_words
from ledgerlens.operators.retrieval import unit

from .pdf import page_texts

NEEDED = {"date", "amount", "type"}
#: Limits of the service and of the gateway before it.
MAX_BYTES, GATEWAY_BYTES = 30 << 20, 50 << 20
MIME = {"pdf": "application/pdf", "csv": "text/csv", "txt": "text/plain", "json": "application/json"}
#: Rows of a CSV file that are given on together.
CSV_BATCH = 10_000
#: Partitions of a vector index; a document is in the one its id's hash names.
INDEX_BUCKETS = 64


CSV_ROWS = "file string, seq bigint, date string, amount double, type string, merchant string, timestamp string, error string"


def csv_table(content: bytes) -> Iterator[tuple]:
    """(seq, date, amount, type, merchant, timestamp, error) of a CSV file's rows; one with a null seq if the file can't be read, at all or from there on."""
    cells = csv.reader(io.TextIOWrapper(io.BytesIO(content), encoding="utf-8-sig", newline=""))
    try:
        names = [c.lower().strip() for c in next(cells, [])]
        at = {c: i for i, c in enumerate(names)}
        if missing := sorted(NEEDED - at.keys()):
            yield None, None, None, None, None, None, f"columns are missing: {missing}"
            return
        if not at.keys() & {"merchant", "description"}:
            yield None, None, None, None, None, None, "a merchant or description column is needed"
            return
        for seq, row in enumerate(r for r in cells if r):
            if len(row) != len(names):
                yield seq, None, None, None, None, None, f"{len(row)} cells for {len(names)} columns"
                continue
            value = {c: row[i].strip() for c, i in at.items()}
            try:
                amount = float(value["amount"])
            except ValueError:
                amount = math.nan
            kind = value["type"].lower()
            error = "amount" if not math.isfinite(amount) else "type" if kind not in ("debit", "credit") else None
            yield seq, value["date"], None if error == "amount" else amount, kind, value.get("merchant") or value.get("description") or "UNKNOWN", value.get("timestamp"), error
    except (UnicodeDecodeError, csv.Error) as e:
        yield None, None, None, None, None, None, f"not a CSV file in UTF-8: {e}"


def csv_rows(binary: DataFrame) -> DataFrame:
    """(file, seq, date, amount, type, merchant, timestamp, error) of binary files (path, content), a batch or a stream.

    Each file has a header of its own, in any order and case, and is read as a whole, so that quoted cells may go over several lines; seq
    numbers its rows from 0. Rows that are too short or long, or whose amount or type can't be read, have that as error; so has a row without seq for
    a file that lacks columns, isn't UTF-8, or breaks off; an empty file has no rows at all. Files are bounded by what a binary cell holds (2 GB); uploads are far below.
    """
    csv.field_size_limit(sys.maxsize)
    names = [c.split()[0] for c in CSV_ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        schema = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("date", pa.string()), ("amount", pa.float64()), *[(c, pa.string()) for c in names[4:]]])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = ((path, *r) for r in csv_table(content.as_py() or b""))
                while part := list(islice(rows, CSV_BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    bounded(binary.sparkSession)
    return binary.select("path", "content").mapInArrow(run, CSV_ROWS)


def readable(rows: DataFrame, statement_id: str = "file") -> DataFrame:
    """The transactions among ``csv_rows``; a file is a statement."""
    return rows.where(F.col("error").isNull()).select(F.col("file").alias(statement_id), "seq", "date", "amount", "type", "merchant", "timestamp")


def transactions_csv(spark: SparkSession, path: str, statement_id: str = "file") -> DataFrame:
    """(statement_id, seq, date, amount, type, merchant, timestamp): rows of the CSV files below ``path`` that can be read, as of ``csv_rows``; a file that can't is an error."""
    rows = written(csv_rows(spark.read.format("binaryFile").load(path)), "csv")
    broken = rows.where(F.col("seq").isNull()).agg(F.min(F.struct("error", "file")).alias("e")).first()["e"]
    if broken:
        raise ValueError(f"{broken['error']} ({broken['file']})")
    return readable(rows, statement_id)


def transactions_csv_stream(spark: SparkSession, path: str, statement_id: str = "file", files_at_once: int = 1000) -> DataFrame:
    """The same of files as they come below ``path``; files that can't be read give no rows."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_at_once).load(path)
    return readable(csv_rows(found), statement_id)


def training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Numeric columns and label (from Class or isFraud, which must be 0 or 1; rows without one are left out)."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    label = next((c for c in ("Class", "isFraud") if c in rows.columns), None)
    if label is None:
        raise ValueError("a label column Class or isFraud is needed")
    numeric = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal") and f.name != label]
    found = rows.select(*numeric, F.col(label).try_cast("double").alias("label"), F.col(label).cast("string").alias("_told")).where(F.col("_told").isNotNull())
    odd = found.where(F.col("label").isNull() | ~F.col("label").isin(0.0, 1.0)).agg(F.min("_told").alias("x")).first()["x"]
    if odd is not None:
        raise ValueError(f"labels must be 0 or 1, and one is {odd}")
    return found.select(*numeric, F.col("label").cast("int").alias("label"))


def numbered(rows: DataFrame, name: str = "row") -> DataFrame:
    """``rows`` with their number from 0 on, in the order of the files; the driver sees one count per partition."""
    marked = rows.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).cast("int")
    sizes = sorted((r["p"], r["n"]) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, base = 0, []
    for p, n in sizes:
        base.append((p, before))
        before += n
    bases = rows.sparkSession.createDataFrame(base, "_p int, _base bigint")
    return marked.withColumn("_p", part).join(F.broadcast(bases), "_p").withColumn(name, F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_base", "_id")


def card_transactions(rows: DataFrame, index: str | None = None) -> DataFrame:
    """Single-row statements from card rows: their number, in the order of the files unless a column gives it, gives the date and merchant."""
    if index is None:
        rows, index = numbered(rows, "_row"), "_row"
    i = F.col(index)
    return rows.where(F.col("Amount").isNotNull() & F.col("Class").isNotNull()).select(
        i.cast("string").alias("statement_id"), F.lit(0).cast("long").alias("seq"), F.format_string("2024-01-%02d 12:00:00", (i % 28 + 1).cast("int")).alias("date"), F.col("Amount").cast("double").alias("amount"),
        F.lit("debit").alias("type"), F.concat(F.lit("Merchant_"), (i % 100).cast("string")).alias("merchant"), F.col("Class").cast("int").alias("label"),
    )


def files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Binary files with their checks: path, length, sha256, mime (by ending), is_pdf (name and first bytes), fits (the service's limit), passes (the gateway's), scanned (there is no scanner)."""
    rows = spark.read.format("binaryFile").load(path)
    pdf = F.lower("path").endswith(".pdf") & (F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.coalesce(*[F.when(ending == k, v) for k, v in MIME.items()], F.lit("application/octet-stream"))
    return rows.select(
        "path", "length", "content", F.sha2("content", 256).alias("sha256"), mime.alias("mime"), pdf.alias("is_pdf"),
        (F.col("length") <= max_bytes).alias("fits"), (F.col("length") <= GATEWAY_BYTES).alias("passes"), F.lit(False).alias("scanned"),
    )


def pages(rows: DataFrame, extract: Callable[[bytes], list[str]] = page_texts) -> DataFrame:
    """(path, page_number, text) of binary files, PDFs unless another extractor is given; a page, or a file, that can't be read is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts = extract(bytes(content))
                except Exception:  # an extractor may fail in any way on a broken file
                    texts = [""]
                yield pd.DataFrame({"path": path, "page_number": range(1, len(texts) + 1), "text": [t.strip() for t in texts]})

    bounded(rows.sparkSession)
    return rows.select("path", "content").mapInPandas(run, "path string, page_number int, text string")


def document_text(page_rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): a document's pages in order with an empty line between them."""
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    return page_rows.where("text <> ''").groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def storage_id(name, stamp):
    """{stem}_{stamp}_{8 hex}, blanks as _."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), " ", "_")
    return F.concat_ws("_", stem, stamp, F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(8)))


def save_texts(rows: DataFrame, path: str, stamp: str, name: str = "name", text: str = "text") -> DataFrame:
    """Add (id, name, text) to the text store below ``path``; (id, name) of what was saved."""
    spark = rows.sparkSession
    made = written(rows.select(storage_id(F.col(name), F.lit(stamp)).alias("id"), F.col(name).alias("name"), F.col(text).alias("text")), "texts")  # ids are drawn once
    made.write.mode("append").parquet(path)
    return made.select("id", "name")


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def replace_documents(spark: SparkSession, path: str, ids: DataFrame, rows: DataFrame | None, key: str, buckets: int) -> None:
    """Rewrite the buckets of ``ids`` without those documents, and with ``rows``."""
    touched = ids.select(bucket_of(key, buckets).alias("bucket")).distinct()
    there = spark.read.parquet(path) if exists(spark, path) else None
    kept = None if there is None else there.join(F.broadcast(touched), "bucket", "left_semi").join(ids.select(key).distinct(), key, "left_anti")
    new = None if rows is None else rows.withColumn("bucket", bucket_of(key, buckets))
    whole = new if kept is None else kept if new is None else kept.unionByName(new, allowMissingColumns=True)
    if whole is None:
        return
    staged = written(whole.repartition("bucket"), "index")  # buckets can't be overwritten while they are read
    empty = [] if there is None else [r["bucket"] for r in touched.join(staged.select("bucket").distinct(), "bucket", "left_anti").collect()]  # at most one row per bucket
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in empty:
        discard(spark, f"{path.rstrip('/')}/bucket={b}")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_index(chunks: DataFrame, path: str, key: str = "document_id", vector: str = "embedding", buckets: int = INDEX_BUCKETS) -> None:
    """Write or replace the index of the documents in ``chunks``, vectors at unit length; other documents stay. Documents share ``buckets`` partitions."""
    rows = chunks.withColumn(vector, unit(F.col(vector))) if vector in chunks.columns else chunks
    replace_documents(chunks.sparkSession, path, chunks.select(key).distinct(), rows, key, buckets)


def read_index(spark: SparkSession, path: str, document: str | None = None, key: str = "document_id", buckets: int = INDEX_BUCKETS) -> DataFrame:
    """The chunks of the index, or of one document, of which one bucket is read."""
    rows = spark.read.parquet(path)
    if document is not None:
        rows = rows.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(str(document))), F.lit(buckets)).cast("int")) & (F.col(key) == document))
    return rows.drop("bucket")


def delete_documents(spark: SparkSession, path: str, ids: DataFrame, key: str = "document_id", buckets: int = INDEX_BUCKETS) -> None:
    """Remove the documents of ``ids`` from the index; ids that aren't there are no error."""
    replace_documents(spark, path, ids, None, key, buckets)


def documents_in(spark: SparkSession, path: str, key: str = "document_id") -> DataFrame:
    """The index's documents, sorted."""
    return spark.read.parquet(path).select(key).distinct().orderBy(key)


def document_exists(spark: SparkSession, path: str, ids: DataFrame, key: str = "document_id") -> DataFrame:
    """``ids`` with whether each is in the index."""
    there = spark.read.parquet(path).select(key).distinct().withColumn("exists", F.lit(True))
    return ids.select(key).distinct().join(there, key, "left").select(key, F.coalesce("exists", F.lit(False)).alias("exists"))


def index_stats(spark: SparkSession, path: str, ids: DataFrame | None = None, key: str = "document_id", content: str = "content") -> DataFrame:
    """(key, chunks, chars, words, mean_chars) of the index's documents, zeros for ``ids`` that aren't there."""
    found = spark.read.parquet(path).groupBy(key).agg(F.count("*").alias("chunks"), F.sum(F.length(content)).alias("chars"), F.sum(blank_words(F.col(content))).alias("words"), F.avg(F.length(content)).alias("mean_chars"))
    if ids is None:
        return found
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(found.schema[c].dataType)).alias(c)
    return ids.select(key).distinct().join(found, key, "left").select(key, *map(zero, ("chunks", "chars", "words", "mean_chars")))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", F.lit(schema)).alias("r")).select("r.*")


def json_value(column: str, path: str, kind: str = "string") -> Column:
    """What stands at a path such as $.a.b in JSON text, null where nothing does."""
    return F.get_json_object(column, path).try_cast(kind)


def write_reports(rows: DataFrame, path: str, text: str = "report") -> None:
    """Reports as text, a row each, parted by an empty line."""
    rows.select(F.concat(F.col(text), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_metrics(summary: DataFrame, path: str) -> None:
    """A table of model metrics as one CSV file with a header below ``path``/metrics, and as text lines below ``path``/summary."""
    shown = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in summary.columns], F.lit(""))
    summary.coalesce(1).write.mode("overwrite").csv(f"{path}/metrics", header=True)
    summary.select(shown.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary")
