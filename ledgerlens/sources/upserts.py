"""Keyed tables on plain files that survive replays: upserts and insert-if-absent, batch by batch, for batch jobs and foreachBatch.

A table is a folder of generations. A batch rewrites the buckets that its keys fall into as a new generation, in a folder of its own name,
and then commits it by one small file, made only if it isn't there yet; readers take each bucket from the generation that the last commit
names. So a job that dies between the two leaves nothing to see, a batch that is replayed is known by its stream's batch id and changes
nothing, and of two writers at once one fails and has touched nothing of the other's. Every row moves once per batch that touches its bucket; only touched buckets are read. Rows keep the
stream and batch that wrote them, and keys that couldn't be inserted are kept as a table of conflicts.

Keys may be null (null is a key of its own). Of a batch's rows with one key the newest counts for upserts, the first for inserts;
ties go to the greater and the lesser row by all columns. An empty batch is committed too, so that it isn't tried again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.storage import discard, written

BUCKETS = 64
#: Columns that the table adds.
OWN = ["_bucket", "_stream", "_batch"]


def folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed generations."""
    place, fs = folder(spark, f"{path}/commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(place)) if fs.exists(place) else []


def last_commit(spark: SparkSession, path: str) -> dict:
    """What the last commit says: its generation, the folder of each bucket, the folders of conflicts, the last batch of each stream."""
    done = commits(spark, path)
    if not done:
        return {"generation": 0, "buckets": {}, "conflicts": [], "streams": {}}
    place, fs = folder(spark, f"{path}/commits/{done[-1]}")
    file = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
    finally:
        file.close()


def commit(spark: SparkSession, path: str, state: dict) -> None:
    """One small file, written beside and renamed, which fails if another writer has taken the number."""
    aside, fs = folder(spark, f"{path}/pending-{state['generation']}-{state['token']}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    place, _ = folder(spark, f"{path}/commits/{state['generation']}")
    fs.mkdirs(place.getParent())
    if fs.exists(place) or not fs.rename(aside, place):
        fs.delete(aside, False)
        raise RuntimeError(f"another writer has committed generation {state['generation']} of {path}")


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str, state: dict, only: set[int] | None = None, kind: str = "rows") -> DataFrame | None:
    """Rows of the buckets, or of ``only`` some of them, from the generations that ``state`` names; None if there are none."""
    where = [f"{path}/{kind}/generation={g}/_bucket={b}" for b, g in state["buckets"].items() if only is None or int(b) in only]
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*where).drop("generation") if where else None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table as of its last commit."""
    state = last_commit(spark, path)
    rows = stored(spark, path, state)
    if rows is None and "schema" in state:
        rows = spark.createDataFrame([], StructType.fromJson(json.loads(state["schema"])))
    if rows is None:
        raise ValueError(f"nothing has been written to {path}")
    return rows.drop(*OWN)


def conflicts(spark: SparkSession, path: str) -> DataFrame | None:
    """(keys, _stream, _batch, reason) of the rows that committed inserts have refused; None if there are none."""
    kept = [f"{path}/conflicts/generation={g}" for g in last_commit(spark, path)["conflicts"]]
    return spark.read.option("basePath", f"{path}/conflicts").parquet(*kept).drop("generation") if kept else None


def applied(state: dict, stream: str, batch: int | None) -> bool:
    return batch is not None and state["streams"].get(stream, -1) >= batch


def write(rows: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], tuple[DataFrame, DataFrame | None]], stream: str, batch: int | None, buckets: int) -> bool:
    """Rewrite the buckets that ``rows`` touch as ``merge`` says and commit; False if the stream's ``batch`` was committed before."""
    spark = rows.sparkSession
    state = last_commit(spark, path)
    if applied(state, stream, batch):
        return False
    if state.setdefault("count", buckets) != buckets or state.setdefault("keys", keys) != keys:
        raise ValueError(f"{path} has {state['count']} buckets by {state['keys']}")
    new = written(rows.withColumns({"_bucket": bucket(keys, buckets), "_stream": F.lit(stream), "_batch": F.lit(-1 if batch is None else batch).cast("long")}), "upsert")  # a source may be read only once
    touched = {r["_bucket"] for r in new.select("_bucket").distinct().collect()}  # at most ``buckets``
    token = uuid.uuid4().hex[:8]
    generation, schema, filled, told = state["generation"] + 1, state.get("schema"), set(), state["conflicts"]
    name = f"{generation}-{token}"
    if touched:
        there = stored(spark, path, state, touched)
        kept, refused = merge(there, new)
        schema = kept.schema.json()
        place = f"{path}/rows/generation={name}"
        kept.repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(place)
        filled = {b for b in touched if folder(spark, f"{place}/_bucket={b}")[1].exists(folder(spark, f"{place}/_bucket={b}")[0])}  # a bucket may have become empty
        if refused is not None:
            refused = written(refused, "refused")
            if not refused.isEmpty():
                refused.write.parquet(f"{path}/conflicts/generation={name}")
                told = [*told, name]
    streams = state["streams"] | ({} if batch is None else {stream: batch})
    own = {b: g for b, g in state["buckets"].items() if int(b) not in touched} | {str(b): name for b in filled}
    commit(spark, path, {"generation": generation, "token": token, "count": buckets, "keys": keys, **({"schema": schema} if schema else {}), "buckets": own, "conflicts": told, "streams": streams})
    return True


def upsert(rows: DataFrame, path: str, keys: list[str], stamp: str, stream: str = "", batch: int | None = None, buckets: int = BUCKETS) -> bool:
    """Put ``rows`` in place of those of equal ``keys`` that aren't newer by ``stamp``; False if the batch was there already."""

    def merge(there: DataFrame | None, new: DataFrame) -> tuple[DataFrame, None]:
        both = new if there is None else there.unionByName(new, allowMissingColumns=True)
        newest = F.struct(F.col(stamp), "_batch", *[c for c in sorted(both.columns) if c not in (stamp, "_batch")])
        return both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*both.columns), newest).alias("_r")).select("_r.*"), None

    return write(rows, path, keys, merge, stream, batch, buckets)


def insert_unique(rows: DataFrame, path: str, keys: list[str], stream: str = "", batch: int | None = None, order: str | None = None, buckets: int = BUCKETS) -> bool:
    """Add the first row (by ``order``) of each key that isn't there; the others become conflicts: reason is "exists" or "repeated"."""

    def merge(there: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        columns = [c for c in new.columns if c != order]
        first = F.struct(*([order] if order else []), *sorted(columns))
        told = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        per = new.groupBy(*told).agg(F.min_by(F.struct(*new.columns), first).alias("_r"), (F.count("*") - 1).alias("_again"))
        if there is None:
            return per.select("_r.*"), report(per.where("_again > 0").select("_r.*", "_again"), "repeated")
        names = there.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)])
        same = F.lit(True)
        for i in range(len(keys)):
            same = same & F.col(f"_k{i}").eqNullSafe(F.col(f"_t{i}"))
        fresh, old = per.join(names, same, "left_anti"), per.join(names, same, "left_semi")
        repeated = report(per.where("_again > 0").select("_r.*", "_again"), "repeated")
        return there.unionByName(fresh.select("_r.*"), allowMissingColumns=True), report(old.select("_r.*").withColumn("_again", F.lit(1).cast("long")), "exists").unionByName(repeated)

    def report(found: DataFrame, reason: str) -> DataFrame:
        return found.select(*keys, "_stream", "_batch", F.lit(reason).alias("reason"), F.col("_again").alias("rows"))

    return write(rows, path, keys, merge, stream, batch, buckets)


def delete(rows: DataFrame, path: str, keys: list[str], stream: str = "", batch: int | None = None, buckets: int = BUCKETS) -> bool:
    """Remove the rows with the keys of ``rows``; keys that aren't there are no error."""

    def merge(there: DataFrame | None, new: DataFrame) -> tuple[DataFrame, None]:
        if there is None:
            return new.where(F.lit(False)), None
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_gone_{k}"))
        gone = new.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct()
        return there.join(gone, same, "left_anti"), None

    return write(rows.select(*keys), path, keys, merge, stream, batch, buckets)


def sink(path: str, keys: list[str], stamp: str, stream: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: upserts, of which replayed batches change nothing."""

    def put(rows: DataFrame, batch: int) -> None:
        upsert(rows, path, keys, stamp, stream, batch, buckets)

    return put


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete generations that no bucket needs any more, and what was never committed; how many. Not while a writer or an old reader is at work."""
    state = last_commit(spark, path)
    needed, gone = {*state["buckets"].values()}, 0
    place, fs = folder(spark, f"{path}/rows")
    for f in fs.listStatus(place) if fs.exists(place) else []:
        if f.getPath().getName().partition("=")[2] not in needed:
            discard(spark, f.getPath().toString())
            gone += 1
    return gone
