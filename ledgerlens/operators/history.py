"""Result history: upserts, access, search, order and level counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.storage import written
from ledgerlens.functions.text import format_bytes


def latest(rows: DataFrame, keys: list[str], stamp: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key: an upsert on plain files. max_by of the whole row combines before the shuffle."""
    order = F.struct(stamp, *([tie] if tie else []))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def insert_unique(stored: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What can be inserted, the first row of each new key, and the keys that are there already."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti"), new.select(key).distinct().join(stored.select(key).distinct(), key)


def visible(rows: DataFrame, user: str, user_id, is_admin: bool, unknown: bool = False) -> DataFrame:
    """Rows of the user, or all for an admin; with ``unknown`` also rows without an owner."""
    own = (F.col(user) == user_id) | (F.col(user).isNull() if unknown else F.lit(False))
    return rows if is_admin else rows.where(own)


def search(rows: DataFrame, columns: list[str], text: str = "", level: str | None = None) -> DataFrame:
    """Rows of the level whose columns contain the text, in any case."""
    hit = F.lit(not text)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
    found = rows.where(hit)
    return found if level is None else found.where(F.col("risk_level") == level)


def newest(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n newest rows, oldest first, with names cut at 14 characters."""
    stamp = F.coalesce("updated_at", "created_at")
    name = F.when(F.length("name") > 14, F.concat(F.left("name", F.lit(14)), F.lit("..."))).otherwise(F.col("name"))
    return rows.withColumn("_at", stamp).orderBy(F.desc("_at"), F.desc("id")).limit(n).withColumn("label", name).orderBy("_at", "id").drop("_at")


def ordered(rows: DataFrame, by: str = "date", descending: bool = True) -> DataFrame:
    """Reports by date, score or name (in any case); ties by id."""
    value = {"date": F.col("created_at"), "score": F.coalesce("risk_score", F.lit(0.0)), "name": F.lower(F.coalesce("name", F.lit("")))}[by]
    return rows.orderBy(value.desc() if descending else value.asc(), "id")


def placed(rows: DataFrame, by: str = "date", descending: bool = True) -> DataFrame:
    """``rows`` with place, from 1 on, in the order of ``ordered``: sorted by ranges and saved, after which each range's first place follows from the sizes of those before."""
    marked = written(ordered(rows, by, descending).withColumn("_id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_id", 33).cast("int")
    sizes = sorted((r["_p"], r["n"]) for r in marked.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).collect())  # one per partition
    bases = rows.sparkSession.createDataFrame([(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)], "_p int, _base bigint")
    return marked.withColumn("_p", part).join(F.broadcast(bases), "_p").withColumn("place", F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_base", "_id")


def with_metadata(rows: DataFrame, documents: DataFrame, key: str, document: str = "document_id") -> DataFrame:
    """``rows`` with the metadata of their document, of which the first row by its columns counts; null where there is none."""
    rest = [c for c in documents.columns if c != document]
    first = documents.groupBy(document).agg(F.min(F.struct(*rest)).alias("_m")).select(F.col(document).alias("_document"), *[F.col(f"_m.{c}").alias(c) for c in rest])
    return rows.join(first, F.col(key) == F.col("_document"), "left").drop("_document")


def type_totals(transactions: DataFrame, key: str = "statement_id") -> DataFrame:
    """(key, total_debit, debit_count, total_credit, credit_count): amounts by type, missing ones as 0."""
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    of = lambda kind: (F.coalesce(F.sum(F.when(F.col("type") == kind, amount)), F.lit(0.0)).alias(f"total_{kind}"), F.count_if(F.col("type") == kind).alias(f"{kind}_count"))
    return transactions.groupBy(key).agg(*of("debit"), *of("credit"))


def first_transactions(transactions: DataFrame, n: int = 10, key: str = "statement_id") -> DataFrame:
    """The first n transactions of each statement, by seq: a preview."""
    return transactions.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where(F.col("_i") <= n).drop("_i")


def document_list(rows: DataFrame) -> DataFrame:
    """What lists of documents show: id, name, size as text, whether there is a file (by the old path), and whether there is a stored blob, if rows name one."""
    there = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) != "") if c in rows.columns else F.lit(False)
    return rows.select("id", "name", format_bytes(F.col("size")).alias("size"), there("file_path").alias("has_pdf"), there("blob_id").alias("has_blob"))


def level_counts(rows: DataFrame) -> DataFrame:
    """One row: reports by level, and the mean score rounded half up."""
    return rows.agg(*[F.count_if(F.col("risk_level") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")], F.count("*").alias("reports"), F.floor(F.avg("risk_score") + 0.5).cast("long").alias("mean_score"))


def subtotals(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """``measures`` of ``rows`` for all keys, for each shorter beginning of them, and for all rows: keys that are summed over are null, and level tells how many count.

    One pass makes all levels (an Expand before the partial aggregate), distinct counts among the measures included; a null key of
    the rows themselves is told from a summed one by level.
    """
    level = F.lit(len(keys)) - F.bit_count(F.grouping_id(*keys))
    return rows.rollup(*keys).agg(*[c.alias(name) for name, c in measures.items()], level.cast("int").alias("level"))


def flagged(rows: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with whether the key is in ``other``."""
    there = other.select(key).distinct().withColumn("_there", F.lit(True))
    return rows.join(there, key, "left").withColumn(name, F.col("_there").isNotNull()).drop("_there")


def accuracy(risk: Column) -> Column:
    return F.floor(F.avg(100 - risk) + 0.5).cast("long")


def prepend_missing(items: Column, item: Column) -> Column:
    return F.when(F.array_contains(items, item), items).otherwise(F.concat(F.array(item), items))


def running_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Business rank: 1 to n by descending keys. All rows are ranked in one sort, meant for a table of models."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*[F.desc(k) for k in keys])))
