"""Exact top-k search over all vectors by MaxScore on postings of dimension and sign.

Entries become integers (``floor(SCALE * c)``). A term is a dimension and a sign; its posting list holds the candidates whose entry has
that sign. Seen from a query, the terms of its own signs gain (each at most |query entry| x the list's largest entry), those of the
opposite signs only lose, so their bound is nothing. Per block of candidates and query the gaining terms are sorted by bound. As many
of the smallest as can't reach the score of the k-th best so far, all together, are non-essential, as are the losing ones: who stands
in no essential list can't be among the best, and is never touched. The essential lists are traversed and added up; for those whom
they name the other terms are probed, the largest first, as long as score and bounds left stay competitive. What reaches the k-th
score exactly is kept, as it may win by its id. Scores are sums of integers, so that all of it is exact.

The queries are dealt to blocks of about ``QUERIES`` whatever their ids and saved; one block at a time is broadcast, and every
partition of the candidates is a shard that keeps its own k best for each query of the block, taking its rows by ``BLOCK`` at a time.
The shards' best are merged by a window over shards x k rows a query, after a partial selection. So the driver holds one block, a task
one block of queries and one of candidates, and nothing pairs rows by a join.

Edge cases: vectors that are null or empty, or hold null, NaN or infinite entries, take no part; shorter vectors count as if filled up with
zeros; scaled entries are held within what a 64-bit sum of products allows. A query's candidates are the rows of other ids: rows that share
its id are its own. Each query row gets its best rows, also if it repeats another; repeated candidates stand side by side. A null id is
no query, and as a candidate loses ties. An empty table, or one without queries, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_batches, saved, table, work_path

SCALE = 256
EVERY = 50
#: Queries that are broadcast together, about, and candidates that a task takes at a time.
QUERIES = 8192
BLOCK = 16_384
NO_ID = (1 << 63) - 1


def integers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """_id (long) and _x (scaled entries, not yet bounded) of the rows that take part."""
    c = F.col("_c")
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    far = float(1 << 52)
    picked = rows.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_c")).where((F.size(c) > 0) & fine)
    return picked.select("_id", F.transform(c, lambda e: F.floor(F.greatest(F.least(e * float(SCALE), F.lit(far)), F.lit(-far)))).alias("_x"))


def matrix(column: pa.Array, d: int, most: int) -> np.ndarray:
    """The vectors of ``column`` as rows of ``d`` entries within ``most``, filled up with zeros."""
    ends = np.asarray(column.offsets)
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return np.clip(out, -most, most)


class Block:
    """Candidates in order of their ids, with a posting list and its largest entry for every dimension and sign."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.by_term = np.ascontiguousarray(self.x.T)
        self.lists = [[np.flatnonzero(row > 0) for row in self.by_term], [np.flatnonzero(row < 0) for row in self.by_term]]
        self.most = np.stack([self.by_term.max(axis=1).clip(0), -self.by_term.min(axis=1).clip(None, 0)])

    def best(self, own: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all candidates that can be among the ``k`` best, given that scores below ``floor`` can't; a few more may come."""
        sign = (q < 0).astype(int)
        terms = np.flatnonzero(q)
        bound = np.abs(q) * self.most[sign, np.arange(len(q))]
        terms = terms[np.argsort(-bound[terms], kind="stable")]
        left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what terms[i:] gain at most
        cut = 0
        if floor is None or floor <= 0:  # who stands in no list of the query at all reaches 0
            alive, score = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)
        else:
            cut = int(np.searchsorted(-left, -floor, side="right"))  # terms[cut:] gain less than floor
            total = np.zeros(len(self.ids), np.int64)
            seen = np.zeros(len(self.ids), bool)
            for t in terms[:cut]:
                posting = self.lists[sign[t]][t]
                total[posting] += q[t] * self.by_term[t, posting]
                seen[posting] = True
            alive = np.flatnonzero(seen)
            score = total[alive]
            alive, score = self.competitive(alive, score, left[cut], floor)
        alive, score = alive[self.ids[alive] != own], score[self.ids[alive] != own]
        # the losing sides of essential terms, the largest first: their bound is nothing
        for t in terms[:cut]:
            score = score + np.minimum(q[t] * self.by_term[t, alive], 0)
            alive, score = self.competitive(alive, score, left[cut], floor)
        for i, t in enumerate(terms[cut:], cut + 1):
            score = score + q[t] * self.by_term[t, alive]
            if floor is not None:
                alive, score = self.competitive(alive, score, left[i], floor)
        return alive, score

    @staticmethod
    def competitive(alive: np.ndarray, score: np.ndarray, gain: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        if floor is None:
            return alive, score
        fit = score + gain >= floor
        return (alive, score) if fit.all() else (alive[fit], score[fit])


def first_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best by score, ties to the smaller id; not many more than k are sorted."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search_block(block: pa.Table, candidates: DataFrame, d: int, most: int, k: int) -> DataFrame:
    """_q (place in the block), query_id, vec_id, score: the ``k`` best of each shard for the queries of ``block``."""
    session = candidates.sparkSession
    own = block.column("_id").to_numpy()
    sent = session.sparkContext.broadcast((own, matrix(block.column("_x").combine_chunks(), d, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

        def take(rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
            part = Block(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
            for i in range(len(ids)):
                kept, scores = found[i]
                # without k scores yet, the k best of a few rows that stand high in the heaviest term give some
                floor = int(scores[k - 1]) if len(kept) >= k else seed(part, int(ids[i]), queries[i], k)
                at, new = part.best(int(ids[i]), queries[i], k, floor)
                if len(at):
                    named, both = np.concatenate([kept, part.ids[at]]), np.concatenate([scores, new])
                    top = first_k(named, both, k)
                    found[i] = named[top], both[top]

        rows, size = [], 0
        for batch in batches:
            if batch.num_rows:
                rows.append((batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), matrix(batch.column(1), d, most)))
                size += batch.num_rows
                if size >= BLOCK:
                    take(rows)
                    rows, size = [], 0
        if rows:
            take(rows)
        counts = [len(f[0]) for f in found]
        if sum(counts):
            place = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
            named = np.concatenate([f[0] for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids[place]), pa.array(named, mask=named == NO_ID), pa.array(np.concatenate([f[1] for f in found]))], ["_q", "query_id", "vec_id", "score"])

    return candidates.select("_id", "_x").mapInArrow(run, "_q int, query_id bigint, vec_id bigint, score bigint")


def seed(block: Block, own: int, q: np.ndarray, k: int) -> int | None:
    """A score that ``k`` candidates of the block reach, from whole scores of some; None if it has fewer."""
    term = int(np.argmax(np.abs(q) * block.most.max(axis=0)))
    row = block.by_term[term] * (1 if q[term] >= 0 else -1)
    some = min(len(row), 16 * k + 1)
    high = np.argpartition(-row, some - 1)[:some]
    high = high[block.ids[high] != own]
    return int(np.sort(block.x[high] @ q)[-k]) if len(high) >= k else None


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of other ids for every row of ``queries``."""
    session = queries.sparkSession
    python_batches(session)
    asked, all_ = saved(integers(queries, vector, key), "topk-queries"), saved(integers(candidates, vector, key), "topk-candidates")
    d = max(all_.agg(F.max(F.size("_x"))).first()[0] or 0, asked.agg(F.max(F.size("_x"))).first()[0] or 0)
    n = asked.count()
    if not n or not d:
        return session.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    blocks = math.ceil(n / QUERIES)
    dealt = saved(asked.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "topk-blocks")
    most = math.isqrt(((1 << 63) - 1) // d)
    path = work_path(session, "topk-shards")
    for b in range(blocks):
        block = dealt.where(F.col("_block") == b).select("_id", "_x").toArrow()
        if block.num_rows:
            found = search_block(block, all_, d, most, k)
            found.withColumn("_block", F.lit(b)).write.mode("append").parquet(path)
    shards = session.read.schema("_q int, query_id bigint, vec_id bigint, score bigint, _block int").parquet(path)
    best = Window.partitionBy("_block", "_q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return shards.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk(spark, sf_dir: str) -> DataFrame:
    """The five best candidates of every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % EVERY == 0), rows)
