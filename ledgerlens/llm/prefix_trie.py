"""Trie of conversation prefixes as succinct level-order tries, one per shard of sorted paths.

A turn's label is 16 bytes of the SHA-256 of role and text, and the text's code points in 4 more; a conversation's path is the string
of its labels. All (path, conv_id) are sorted by ranges, so that a shard is an unbroken stretch of the order, however common a path
or a beginning of paths is. Each shard builds in numpy, level by level, the LOUDS bit vector of its trie (a node's degree in ones,
then a zero) with the labels in the same order, reads the parents off it, and rolls up counts from the last level to the first with
``add.at``.

Only nodes on the path of a shard's first or last row can stand in other shards as well: these are the heavy upper levels. The shard
finishes all other nodes and hands on those two paths with what it knows of their nodes. Up to ``FAN`` shards' paths, neighbours in
the order, make a shard of the next round, which merges them by the same code, and so on until one shard is left; rounds grow as the
logarithm of the shards. Nodes whose parent was unfinished get its id by a join on the hash of its path; so do nodes that got ids of
conversations in several shards, whose digests are streamed over the shards' stretches of ids.

What moves is 20 bytes a turn besides the turns themselves, which are sorted within their conversations; a task holds a shard of about
``SHARD_TURNS`` labels, and a path is as long as its conversation.

Edge cases: null role or text is empty; turns without conv_id take no part; of turns with equal numbers the order is that of role,
then text, so that repeated rows are turns of their own; without any conversation there is no node, not even the root; other columns are
not read. conv_id % 100 has the sign of conv_id, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, python_batches, saved, small, table

LABEL = 20
SHARD_TURNS = 200_000
FAN = 256
NONE = np.iinfo(np.int64).max
GROUP = 100
HEADS = 6
#: Ids in one stretch of an unfinished node's list.
STRETCH = 8192

NODE = "kind int, shard int, depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, node binary, parent binary"
PATH = "path binary, members array<bigint>, low array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>"
STRETCHES = "first bigint, ids string"
#: One schema for the three kinds of rows that a shard gives.
OUT = f"{NODE}, {PATH}, {STRETCHES}"
CLOSED, BORDER, ENDS = 0, 1, 2
FIELDS = ["members", "low", "kids", "leaves", "saved"]


def labelled(turns: DataFrame) -> DataFrame:
    """conv_id and labels (hex, in order of the turns) of every conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("_role"), text.alias("_text"))
    label = F.concat(F.substring(F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256), 1, 32), F.lpad(F.hex(F.length("_text")), 8, "0"))
    placed = rows.withColumn("_pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "_role", "_text")))
    per = placed.select("conv_id", F.struct("_pos", label.alias("label")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return per.select("conv_id", F.col("t.label").alias("labels"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its hundred, h of them, h being its id's CRC-32 modulo ``HEADS``."""
    c = F.col("conv_id")
    heads = conversations.where(c % GROUP == 0).select(c.alias("_base"), F.slice("labels", 1, HEADS - 1).alias("_head"))
    h = (F.crc32(c.cast("string").cast("binary")) % HEADS).cast("int")
    own = conversations.select("conv_id", "labels", (c - c % GROUP).alias("_base"), h.alias("_h"))
    head = F.coalesce(F.expr("slice(_head, 1, _h)"), F.array().cast("array<string>"))
    return own.join(heads, "_base", "left").select("conv_id", F.concat(head, F.expr("slice(labels, _h + 1, greatest(size(labels) - _h, 0))")).alias("labels"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path (binary) from conv_id and labels (hex)."""
    return conversations.select("conv_id", F.unhex(F.array_join("labels", "")).alias("path"))


class Louds:
    """A level-order tree: for every node, and one above the root, its degree in ones and then a zero."""

    def __init__(self, degrees: np.ndarray):
        self.degrees = degrees
        self.bits = np.zeros(2 + len(degrees) + int(degrees.sum()), bool)
        self.bits[0] = True
        ends = 1 + np.cumsum(degrees + 1)  # the zero after each node's ones
        self.bits[2:] = True
        self.bits[ends] = False

    def parents(self) -> np.ndarray:
        """Node i is the i-th one; the zeros before it, less that of the node above the root, are its parent's number (-1 for the root)."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1


@dataclass
class Trie:
    """Level-order nodes of sorted paths: ``at`` has the nodes of each path, root first; ``levels`` where each level's nodes begin."""

    louds: Louds
    parent: np.ndarray
    label: np.ndarray
    levels: list[int]
    at: np.ndarray
    starts: np.ndarray


def build(flat: np.ndarray, lengths: np.ndarray) -> Trie:
    """The trie of paths whose labels stand one after another in ``flat``; paths are in order."""
    n = len(lengths)
    begin = np.cumsum(lengths) - lengths
    starts = begin + np.arange(n)
    at = np.zeros(len(flat) + n, np.int64)
    node, live = np.zeros(n, np.int64), np.arange(n)
    levels, count = [0, 1], 1
    labels, ups = [np.zeros(1, flat.dtype)], [np.array([-1])]
    depth = 0
    while True:
        live = live[lengths[live] > depth]
        if not len(live):
            break
        own, up = flat[begin[live] + depth], node[live]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (up[1:] != up[:-1])
        node[live] = count - 1 + np.cumsum(fresh)
        labels.append(own[fresh])
        ups.append(up[fresh])
        count += int(fresh.sum())
        levels.append(count)
        depth += 1
        at[starts[live] + depth] = node[live]
    louds = Louds(np.bincount(np.concatenate(ups)[1:], minlength=count))
    return Trie(louds, louds.parents(), np.concatenate(labels), levels, at, starts)


def key_of(path: bytes, depth: int) -> bytes:
    """What names a node outside its shard."""
    return hashlib.sha256(path[: depth * LABEL]).digest()


@dataclass
class Shard:
    """Paths in order with what is known of their nodes: one row per path, arrays over its nodes from the root on."""

    paths: list[bytes]
    known: dict[str, np.ndarray]

    def __post_init__(self):
        self.lengths = np.array([len(p) // LABEL for p in self.paths], np.int64)
        self.trie = build(np.frombuffer(b"".join(self.paths), f"V{LABEL}"), self.lengths)

    def path_nodes(self, row: int) -> np.ndarray:
        return self.trie.at[self.trie.starts[row] : self.trie.starts[row] + self.lengths[row] + 1]

    def rolled(self, last: bool) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Values of all nodes, and which are unfinished: those on the first and the last path, unless it is the ``last`` shard."""
        trie = self.trie
        size = len(trie.parent)
        value = {f: np.full(size, NONE) if f == "low" else np.zeros(size, np.int64) for f in FIELDS}
        for f in FIELDS:
            (np.minimum if f == "low" else np.add).at(value[f], trie.at, self.known[f])
        border = np.zeros(size, bool)
        if not last:
            border[self.path_nodes(0)] = border[self.path_nodes(len(self.paths) - 1)] = True
        chars = np.frombuffer(trie.label.tobytes(), np.uint8).reshape(-1, LABEL)[:, LABEL - 4 :].astype(np.int64) @ (256 ** np.arange(3, -1, -1))
        for begin, end in zip(trie.levels[-2::-1], trie.levels[:0:-1], strict=True):
            own = np.arange(begin, end)[~border[begin:end]]
            value["leaves"][own] += value["kids"][own] == 0
            value["saved"][own] += (value["members"][own] - 1) * chars[own]
            if begin == 0:
                break
            up = trie.parent[own]
            for f in ("members", "leaves", "saved"):
                np.add.at(value[f], up, value[f][own])
            np.minimum.at(value["low"], up, value["low"][own])
            np.add.at(value["kids"], up, 1)
        return value, border

    def rows(self, number: int, last: bool, ends: dict[int, str]) -> Iterator[pa.RecordBatch]:
        """Finished nodes, then the two unfinished paths. ``ends``: digests of the lists that are whole; others are null, but empty for nodes without any."""
        value, border = self.rolled(last)
        trie = self.trie
        depth = np.repeat(np.arange(len(trie.levels) - 1), np.diff(trie.levels))
        done = np.flatnonzero(~border)
        inner = trie.parent[done] >= 0
        up = np.where(inner, trie.parent[done], 0)
        open_up = border[up] & inner
        row_of = self.any_row()
        low = value["low"]
        keys = {int(i): key_of(self.paths[row_of[i]], int(depth[i])) for i in np.unique(up[open_up])}
        yield batch(
            len(done), kind=np.full(len(done), CLOSED), shard=np.full(len(done), number), depth=depth[done], conv_id=low[done],
            parent_conv_id=pa.array(low[up], mask=~inner | open_up), n_convs=value["members"][done], n_children=value["kids"][done],
            n_leaves=value["leaves"][done], saved_tokens=value["saved"][done], ends_sha256=[ends.get(int(i)) for i in done],
            node=[key_of(self.paths[row_of[i]], int(depth[i])) if ends.get(int(i)) is None else None for i in done],
            parent=[keys[int(i)] if o else None for i, o in zip(up, open_up, strict=True)],
        )
        if last:
            return
        first = self.path_nodes(0)
        sides = [(0, first)]
        if len(self.paths) > 1 and self.paths[-1] != self.paths[0]:
            sides.append((len(self.paths) - 1, self.path_nodes(len(self.paths) - 1)))
        told = {f: [] for f in FIELDS}
        for _, nodes in sides:
            again = np.isin(nodes, first) if nodes is not first else np.zeros(len(nodes), bool)
            for f in FIELDS:
                told[f].append(np.where(again, NONE if f == "low" else 0, value[f][nodes]))
        yield batch(len(sides), kind=[BORDER] * len(sides), shard=[number] * len(sides), path=[self.paths[i] for i, _ in sides], **{f: pa.array([x.tolist() for x in told[f]], pa.list_(pa.int64())) for f in FIELDS})

    def any_row(self) -> np.ndarray:
        """For each node some path that it stands on."""
        out = np.zeros(len(self.trie.parent), np.int64)
        out[self.trie.at] = np.repeat(np.arange(len(self.paths)), self.lengths + 1)
        return out


KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
COLUMNS = {name: KINDS[kind] for name, kind in (c.split() for c in OUT.split(", "))}


def batch(rows: int, **given) -> pa.RecordBatch:
    """Columns of ``OUT``, null where none are given."""
    made = {c: pa.nulls(rows, t) if c not in given else given[c] if isinstance(given[c], pa.Array) and given[c].type == t else pa.array(given[c]).cast(t) if isinstance(given[c], np.ndarray) else pa.array(given[c], t) for c, t in COLUMNS.items()}
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


EMPTY = hashlib.sha256(b"").hexdigest()


def first_shard(number: int, paths_: list[bytes], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a shard of single conversations, sorted by path and id."""
    shard_lengths = np.array([len(p) // LABEL for p in paths_], np.int64)
    size = int(shard_lengths.sum()) + len(paths_)
    tails = np.cumsum(shard_lengths + 1) - 1
    known = {f: np.full(size, NONE) if f == "low" else np.zeros(size, np.int64) for f in FIELDS}
    known["members"][tails], known["low"][tails] = 1, ids
    shard = Shard(paths_, known)
    ending = shard.trie.at[tails]
    _, where, counts = np.unique(ending, return_index=True, return_counts=True)
    border = set(shard.path_nodes(0).tolist()) | set(shard.path_nodes(len(paths_) - 1).tolist())
    ends = dict.fromkeys(range(len(shard.trie.parent)), EMPTY)
    stretches = []
    for begin, n in zip(where.tolist(), counts.tolist(), strict=True):  # equal paths stand together
        node = int(ending[begin])
        listed = ids[begin : begin + n].tolist()
        if node not in border:
            ends[node] = hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()
            continue
        key = hashlib.sha256(paths_[begin]).digest()
        stretches += [(key, part[0], ",".join(map(str, part))) for part in (listed[i : i + STRETCH] for i in range(0, n, STRETCH))]
    yield from shard.rows(number, False, ends)
    if stretches:
        yield batch(len(stretches), kind=[ENDS] * len(stretches), shard=[number] * len(stretches), node=[s[0] for s in stretches], first=[s[1] for s in stretches], ids=[s[2] for s in stretches])


def shards(sorted_paths: DataFrame) -> DataFrame:
    """The rows of all shards, one per partition of ``sorted_paths`` (conv_id, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = [], []
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            own += b.column(1).to_pylist()
        if own:
            yield from first_shard(TaskContext.get().partitionId(), own, np.concatenate(ids))

    return sorted_paths.select("conv_id", "path").mapInArrow(run, OUT)


def merged(borders: DataFrame, last: bool) -> DataFrame:
    """The rows of shards that are made of ``FAN`` neighbours' unfinished paths each."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["path"])
        known = {f: np.concatenate([np.array(r[f], np.int64) for r in rows]) for f in FIELDS}
        return pa.Table.from_batches(list(Shard([r["path"] for r in rows], known).rows(key[0].as_py(), last, {})))

    return borders.select((F.col("shard") / FAN).cast("int").alias("shard"), *[c.split()[0] for c in PATH.split(", ")]).groupBy("shard").applyInArrow(run, OUT)


def digests(stretches: DataFrame) -> DataFrame:
    """_node and _ends, the digest of its stretches of ids, one after another; streamed, so that no list is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["_node", "_ends"])

        for b in batches:
            for own, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own != node:
                    if node is not None:
                        yield told()
                    node, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node is not None:
            yield told()

    dealt = stretches.select("node", "ids", "first").repartition("node").sortWithinPartitions("node", "first")
    return dealt.select("node", "ids").mapInArrow(run, "_node binary, _ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node, from conv_id and path of every conversation."""
    session = conversations.sparkSession
    python_batches(session)
    all_ = saved(conversations.select("conv_id", "path"), "trie-paths")
    turns = all_.agg((F.sum(F.octet_length("path")) / LABEL).cast("long")).first()[0] or 0
    count = max(partitions(session), turns // SHARD_TURNS)
    rows = saved(shards(all_.repartitionByRange(count, "path", "conv_id").sortWithinPartitions("path", "conv_id")), "trie-shards")
    closed = [rows.where(F.col("kind") == CLOSED)]
    ends = rows.where(F.col("kind") == ENDS)
    while True:
        borders = rows.where(F.col("kind") == BORDER)
        most = borders.agg(F.max("shard")).first()[0]
        if most is None:
            break
        rows = saved(merged(borders, most < FAN), "trie-merged")
        closed.append(rows.where(F.col("kind") == CLOSED))
    wanted = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node", "parent"]
    upper = closed[1].select(*wanted) if len(closed) > 1 else closed[0].where(F.lit(False)).select(*wanted)
    for more in closed[2:]:
        upper = upper.unionByName(more.select(*wanted))
    n = upper.count()
    found = upper.join(digests(ends), F.col("node") == F.col("_node"), "left").withColumn("ends_sha256", F.coalesce("_ends", F.lit(EMPTY)))
    all_nodes = closed[0].select(*wanted).unionByName(found.select(*wanted))
    above = small(upper.select(F.col("node").alias("_up"), F.col("conv_id").alias("_up_id")), n)
    named = all_nodes.where(F.col("parent").isNotNull()).join(above, F.col("parent") == F.col("_up"))
    rest = all_nodes.where(F.col("parent").isNull())
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return rest.select(*out).unionByName(named.withColumn("parent_conv_id", F.col("_up_id")).select(*out))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """All nodes of the rebuilt conversations' trie."""
    rows = trie(paths(rebuilt(labelled(table(spark, sf_dir, "conversations")))))
    return rows.withColumn("depth", F.col("depth").cast("long"))
