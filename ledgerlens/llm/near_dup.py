"""Near duplicates by Order MinHash with banded alignment.

Texts are compared as their lower-cased words. Equal word sequences are one node, whatever the ids of their rows. A sketch samples
the ``KEPT`` least of a node's occurrence-labelled ``SHINGLE``-word shingles under each of ``SAMPLES`` hash orders and keeps them in
text order, so that it is sensitive to edits and moves. Nodes that share a sample are candidates, and a pair is a link if the
word-level edit distance, by banded alignment, is at most 1 - ``SIMILARITY`` of the longer text. Links make classes.

The rule that holds in every bucket: texts of shingle similarity 0.8 or more that align are in one class, with a probability above
0.999. Texts of a lower shingle similarity that align are linked if they meet: with probability 0.96 at 0.6 in the first sketch.

All pairs of a bucket of up to ``ALL_PAIRS`` nodes are aligned. In a larger bucket every node meets two hubs: the node that stands in
the fullest buckets, which in a group of edited copies is the one they come from, and the least node. Where that leaves a large
bucket with more than one class, its nodes, linked or not, are dealt again, by their rarest words: texts that align have all but a
fifth of the longer one's words in common, each as often, so that they share one of the rarest fifth of their words and one more, in any order that is the same for
all. Large buckets of those words that still hold several classes are settled whole: their nodes outside the bucket's largest class become
hubs that meet all its nodes of other classes, four times as many in each round, save those that have joined that class meanwhile, until
all have been. Of two nodes of different classes one at least is such a hub, so that none is left untested; nodes that share several
buckets meet in the least. Classes are found once for each node and bucket, and after that only for hubs and pairs. So two texts that share a sample and align are in one class, however full the bucket is;
none is cut or sampled, no pair within a class is tested for its own sake, and the rounds are as many as the logarithm of a bucket's nodes.
Classes are distributed connected components.

Edge cases: a text without words equals only texts that are the same as a whole; texts of fewer than five words are one shingle;
null texts are empty; repeated rows, and rows of equal words, are one node, of which one text is aligned; an id with several texts may be in
several classes, which are then named by their least id that is in no other class (by the least id at all if there is none); rows without
doc_id join classes like others but don't name them, and a class without any id has the null id; an empty table has no classes;
texts of any length are sketched and aligned whole; ids of any sortable type will do; other columns aren't read and come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.matrices import summed

from .common import covered, python_batches, saved, small, table, uncovered
from .components import components
from .decontaminate import RAW_WORD

SHINGLE = 5
SIMILARITY = 0.8
#: Samples of a sketch and shingles of a sample.
SAMPLES, KEPT = 24, 4
#: Places, as rows and columns, at which words are counted to tell the rare ones. Words that share a place only make each other look more frequent.
PLACES = (256, 64)
#: Least buckets of a node that its rows carry, so that two nodes are paired in the least they share and seldom in another.
LEAST = 64
#: Nodes of a bucket up to which all its pairs are aligned.
ALL_PAIRS = 8
#: Hubs of a bucket in the first settling round, and how many times more there are in each further one.
HUBS, MORE_HUBS = 4, 4
#: Cells of one block of hashes or of one row of a batch of alignments.
BLOCK = 2_000_000
FAR = 1 << 28

MIX = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.random.default_rng(10).integers(0, 2**63, 512, dtype=np.int64).astype(np.uint64)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RAW_WORD), F.lit(0))


def node_key(text: Column, words: Column) -> Column:
    """16 bytes that stand for the word sequence, or for the text if it has no words."""
    return F.unhex(F.md5(F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a document, each with its number among equal ones, from the hashes of its words (not empty)."""
    w = words.view(np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        shingles = mixed(shingles * MIX + w[k : k + n])
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    nth = np.empty(n, np.uint64)
    nth[order] = (np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))).astype(np.uint64)
    return mixed(shingles + nth * MIX)


def sampled(labelled: np.ndarray, samples: int, keep: int) -> np.ndarray:
    """A hash of each sample: the ``keep`` least shingles under each hash order, in text order."""
    n = len(labelled)
    out = np.empty(samples, np.uint64)
    kept, rows, seeds = min(keep, n), max(1, BLOCK // n), SEEDS[:samples]
    for a in range(0, samples, rows):
        keys = mixed(labelled[None, :] ^ seeds[a : a + rows, None])
        places = np.argpartition(keys, kept - 1, axis=1)[:, :kept] if kept < n else np.tile(np.arange(n), (len(keys), 1))
        found = labelled[np.sort(places, axis=1)]
        total = mixed(seeds[a : a + rows] + MIX * np.uint64(keep))
        for k in range(kept):
            total = mixed(total * MIX + found[:, k])
        out[a : a + rows] = total
    return out.view(np.int64)


def sketch(words: np.ndarray) -> np.ndarray:
    return sampled(labelled_shingles(words), SAMPLES, KEPT)


def labelled_words(words: np.ndarray) -> np.ndarray:
    """Hashes of the words of a document, each with its number among equal ones."""
    w = np.sort(words.view(np.uint64))
    starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    nth = np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w))))
    return mixed(w + nth.astype(np.uint64) * MIX)


def frequencies(texts: DataFrame) -> np.ndarray:
    """How often labelled words of (node, text) occur, by place."""
    size = PLACES[0] * PLACES[1]

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        flat, cuts = batch.column(0).values.to_numpy(zero_copy_only=False), batch.column(0).offsets.to_numpy()
        with np.errstate(over="ignore"):
            found = [labelled_words(flat[a:b]) % np.uint64(size) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return np.bincount(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64), minlength=size).reshape(PLACES).astype(float)

    return summed(texts.select(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words")), counts, *PLACES).ravel()


def rarest(seen: np.ndarray, similarity: float) -> Callable[[np.ndarray], np.ndarray]:
    """The rarest labelled words of a document, of which texts that align share one: one more than may be edited."""

    def chosen(words: np.ndarray) -> np.ndarray:
        labelled = labelled_words(words)
        order = np.lexsort((labelled, seen[(labelled % np.uint64(len(seen))).astype(np.int64)]))
        return labelled[order[: int((1 - similarity) * len(words) + 1e-9) + 1]].view(np.int64)

    return chosen


def sketches(texts: DataFrame, made_by: Callable[[np.ndarray], np.ndarray] = sketch) -> DataFrame:
    """(id, key, n, samples array<long>) of every row of (id, text): the key of its words, their number, and no samples without words."""
    python_batches(texts.sparkSession)
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_words", words_of(F.col("_text")))
    rows = rows.select("id", node_key(F.col("_text"), F.col("_words")).alias("key"), F.transform("_words", lambda w: F.xxhash64(w)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                words = batch.column(2)
                flat, offsets = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
                keys, made = batch.column(1).to_pylist(), {}
                for k, a, b in zip(keys, offsets, offsets[1:], strict=False):
                    if k not in made:
                        made[k] = made_by(flat[a:b]) if b > a else np.empty(0, np.int64)
                out = [made[k] for k in keys]
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in out])))
                samples = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int32)), samples], ["id", "key", "n", "samples"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary, n int, samples array<bigint>")


def banded(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, width: int) -> np.ndarray:
    """Edit distances of the rows of ``a`` and ``b`` within a band of ``width`` diagonals to each side, FAR or more where it is left.

    ``a`` and ``b`` are padded with values that are equal to nothing; ``la`` and ``lb`` are the rows' lengths.
    """
    n, wide = len(a), 2 * width + 1
    k = np.arange(wide, dtype=np.int32)
    padded = np.full((n, a.shape[1] + wide + b.shape[1] + 1), -1, np.int64)
    padded[:, width : width + b.shape[1]] = b
    row = np.broadcast_to(np.where(k >= width, k - width, FAR).astype(np.int32), (n, wide)).copy()
    out = np.full(n, FAR, np.int32)
    end = lb - la + width
    inside = (end >= 0) & (end < wide)
    done = np.flatnonzero((la == 0) & inside)
    out[done] = row[done, end[done]]
    for i in range(1, a.shape[1] + 1):
        step = row + (padded[:, i - 1 : i - 1 + wide] != a[:, i - 1 : i])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(step - k, axis=1) + k
        done = np.flatnonzero((la == i) & inside)
        if len(done):
            out[done] = row[done, end[done]]
    return out


def alike(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs of word arrays have an edit distance of at most (1 - similarity) of the longer one."""
    good = np.zeros(len(pairs), bool)
    todo = []
    for i, (a, b) in enumerate(pairs):
        long = max(len(a), len(b))
        limit = int((1 - similarity) * long + 1e-9)
        if abs(len(a) - len(b)) > limit:
            continue
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        head = int(differ[0]) if len(differ) else m
        a, b = a[head:], b[head:]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[::-1][:m] != b[::-1][:m])
        tail = int(differ[0]) if len(differ) else m
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if max(len(a), len(b)) <= limit:
            good[i] = True
            continue
        values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
        in_a = np.searchsorted(np.sort(a), values, "right") - np.searchsorted(np.sort(a), values, "left")
        if max(len(a), len(b)) - int(np.minimum(in_a, counts - in_a).sum()) <= limit:  # no alignment can match more than the common words
            todo.append((i, a, b, limit, abs(len(a) - len(b)) + 12))
    while todo:
        todo.sort(key=lambda t: (t[4].bit_length(), len(t[1])))
        again, at = [], 0
        while at < len(todo):
            width, part, longest = 0, [], 0
            while at < len(todo) and (not part or todo[at][4].bit_length() == part[0][4].bit_length()):
                w, m = max(width, min(todo[at][4], todo[at][3])), max(longest, len(todo[at][1]), len(todo[at][2]))
                if part and (len(part) + 1) * max(2 * w + 1, m // 4) > BLOCK // 16:
                    break
                part.append(todo[at])
                width, longest, at = w, m, at + 1
            la, lb = np.array([len(t[1]) for t in part]), np.array([len(t[2]) for t in part])
            a, b = np.full((len(part), la.max()), -2, np.int64), np.full((len(part), lb.max()), -3, np.int64)
            for r, t in enumerate(part):
                a[r, : la[r]], b[r, : lb[r]] = t[1], t[2]
            for t, d in zip(part, banded(a, b, la, lb, width), strict=True):
                if d <= t[3]:
                    good[t[0]] = True
                elif width < t[3]:
                    again.append((*t[:4], 2 * width + 1))
        todo = again
    return good


def node_texts(nodes: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the ``wanted`` nodes, one row each: of the rows with a node's least id, one that has its words. Texts are shuffled once."""
    some = saved(nodes.join(wanted, "node", "left_semi").select("node", "key", "low"), "wanted", shrink=8)
    ids = some.select(F.col("low").alias("_low")).distinct()
    rows = docs.select(F.col("doc_id").alias("_id"), "text")
    rows = rows.join(small(ids, some.count()), F.col("_id") == F.col("_low"), "left_semi").select(node_key(F.col("text"), words_of(F.col("text"))).alias("key"), "text")
    return rows.dropDuplicates(["key"]).join(some.select("node", "key"), "key").select("node", "text")


def aligned(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``pairs`` (a, b) with good: whether the ``texts`` (node, text) of the two nodes align.

    The first join deals pairs by a, which is in few of them; the second by b, the hub of large buckets, with rows that are heavy
    enough for adaptive execution to split. Both go by shuffle at any size.
    """
    texts = texts.select("node", F.transform(words_of(F.col("text")), lambda w: F.hash(w)).alias("_w"))
    first = texts.select(F.col("node").alias("a"), F.col("_w").alias("wa"))
    second = texts.select(F.col("node").alias("b"), F.col("_w").alias("wb"))
    rows = pairs.select("a", "b").join(first.hint("merge"), "a").join(second.hint("merge"), "b").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                flat, cuts = batch.column(c).values.to_numpy(zero_copy_only=False), batch.column(c).offsets.to_numpy()
                sides.append([flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike(list(zip(*sides, strict=True)), similarity))], ["a", "b", "good"])

    return rows.mapInArrow(run, "a bigint, b bigint, good boolean")


def near_in_length(x: str, y: str, similarity: float) -> Column:
    """Whether texts of so many words can align: the rest are no links."""
    return F.abs(F.col(x) - F.col(y)) <= (1 - similarity) * F.greatest(x, y) + 1e-9


def hub_pairs(buckets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a above b, of small buckets and with the two hubs of each larger one, and the larger buckets' rows."""
    sizes = saved(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes", shrink=4)  # so that a join with a full bucket can be split
    members = buckets.join(sizes, "bucket")
    few = members.where(F.col("size") <= ALL_PAIRS)
    close = few.select("bucket", F.col("node").alias("a"), F.col("n").alias("na")).join(few.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb")), "bucket").where("a > b")
    many = saved(members.where(F.col("size") > ALL_PAIRS), "many", shrink=8)
    weight = many.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = saved(many.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("_top"), F.min(F.struct("node", "n")).alias("_low")), "hubs", shrink=8)
    spokes = many.select("bucket", "node", "n").join(small(hubs, hubs.count()), "bucket")
    to_hub = [spokes.where(F.col("node") != h["node"]).select(F.greatest("node", h["node"]).alias("a"), F.least("node", h["node"]).alias("b"), F.col("n").alias("na"), h["n"].alias("nb")) for h in (F.col("_top"), F.col("_low"))]
    pairs = close.select("a", "b", "na", "nb").unionByName(to_hub[0]).unionByName(to_hub[1])
    return pairs.where(near_in_length("na", "nb", similarity)).select("a", "b").distinct(), many.drop("size")


def classed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` of a node each, or of a node and bucket, with the node's class (root)."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def unsettled(rows: DataFrame) -> DataFrame:
    """The ``rows`` (bucket, node, n, root) of large buckets that hold more than one class."""
    several = rows.groupBy("bucket").agg(F.min("root").alias("_x"), F.max("root").alias("_y"), F.count("*").alias("_c")).where((F.col("_x") != F.col("_y")) & (F.col("_c") > ALL_PAIRS))
    return rows.join(several.select("bucket"), "bucket", "left_semi")


def hub_order(rows: DataFrame) -> DataFrame:
    """``rows`` with a node of their bucket's largest class (main), and numbers from 1 on (i) for those of other classes, null for those of that class."""
    most = rows.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("_m")).select("bucket", F.col("_m.root").alias("main"))
    outside = F.col("root") != F.col("main")
    return rows.join(most, "bucket", "left").withColumn("i", F.when(outside, F.row_number().over(Window.partitionBy("bucket", outside).orderBy("node"))))


def by_class(rows: DataFrame, x: str, y: str, roots: DataFrame) -> DataFrame:
    """``rows`` with the classes of their nodes x and y as rx and ry."""
    for c in (x, y):
        rows = rows.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    return rows


def settling_pairs(rows: DataFrame, chosen: DataFrame, skipped: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the ``chosen`` hubs with the later nodes of other classes in their buckets of ``rows``, with those outside its order, and with the earlier ones that were ``skipped`` as hubs.

    Nodes that share a lesser bucket, as their ``LEAST`` ones tell, meet there: two classes that share a bucket aren't both its largest, and
    all pairs of a small one have been tested.
    """
    hubs = chosen.select("bucket", F.col("node").alias("hub"), F.col("n").alias("nh"), F.col("root").alias("rh"), F.col("least").alias("lh"), F.col("i").alias("ih"))
    others = rows.withColumn("again", F.lit(False)).unionByName(skipped.withColumn("again", F.lit(True)))
    once = F.col("i").isNull() | ((F.col("i") > F.col("ih")) != F.col("again"))
    first = F.coalesce(F.array_min(F.array_intersect("least", "lh")), F.col("bucket")) >= F.col("bucket")
    met = others.join(small(hubs, chosen.count()), "bucket").where((F.col("root") != F.col("rh")) & near_in_length("n", "nh", similarity) & once & first)
    return met.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def roots_of(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of every node that isn't the root of its class; ``nodes``: node, key, low (an id), n, samples."""
    dealt = lambda df, *more: df.select("node", "n", *more, F.explode("samples").alias("bucket"))
    between = lambda rows: by_class(rows, "a", "b", roots).where("ra <> rb")
    tested: DataFrame | None = None
    roots: DataFrame | None = None

    def linked(pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """Classes by all links up to those of ``pairs``: pairs within a class aren't aligned, new links are taken between the classes there are."""
        nonlocal tested, roots
        if roots is not None:
            pairs = between(saved(pairs, "met", shrink=8).join(tested, ["a", "b"], "left_anti"))
        pairs = saved(pairs, "pairs", shrink=8)
        ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        own = node_texts(nodes, ids, docs) if texts is None else texts.join(ids, "node", "left_semi")
        good = saved(aligned(pairs, own, similarity), "aligned", shrink=4).where("good").select("a", "b")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        if roots is None:
            roots = components(good)
            return roots
        merged = components(between(good).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        up = merged.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        roots = saved(roots.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")).unionByName(merged).distinct(), "classes", shrink=8)
        return roots

    pairs, many = hub_pairs(dealt(nodes), similarity)
    roots = linked(pairs)
    crowd = saved(unsettled(saved(classed(many, roots), "classed", shrink=8)).select("node").distinct(), "crowd", shrink=8)
    if crowd.isEmpty():
        return roots
    texts = saved(node_texts(nodes, crowd, docs), "texts", shrink=2)  # all that the rest looks at
    fine = saved(sketches(texts.withColumnRenamed("node", "id"), rarest(frequencies(texts), similarity)).withColumnRenamed("id", "node"), "fine", shrink=2)
    pairs, many = hub_pairs(saved(dealt(fine, F.slice(F.array_sort("samples"), 1, LEAST).alias("least")), "dealt", shrink=4), similarity)
    roots = linked(pairs, texts)
    # each row finds its class once, before the rounds; what they merge is looked up for hubs and pairs
    rows = saved(hub_order(unsettled(saved(classed(many, roots), "classed", shrink=4))), "unsettled", shrink=4)
    last, since, hubs, skipped = rows.agg(F.max("i")).first()[0] or 0, 0, HUBS, rows.limit(0)
    while since < last:
        part = saved(by_class(rows.where((F.col("i") > since) & (F.col("i") <= since + hubs)), "root", "main", roots), "hubs", shrink=8)
        skipped = skipped.unionByName(part.where("rroot = rmain").select(*rows.columns))
        later = rows.where(F.col("i").isNull() | (F.col("i") > since))
        roots = linked(settling_pairs(later, part.where("rroot <> rmain"), skipped, similarity), texts)
        since, hubs = since + hubs, hubs * MORE_HUBS
    return roots


def named(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, root) of every row, and (root, class_id, lead) of every class: its id and the key of the text that stands for it."""
    rows = saved(sketches(docs.select(F.col("doc_id").alias("id"), "text")), "sketches")
    per = rows.groupBy("key").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("samples").alias("samples"))
    nodes = saved(per.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = roots_of(nodes.where(F.col("low").isNotNull() & (F.size("samples") > 0)), docs, similarity)
    of_key = saved(nodes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root")), "roots", shrink=4)
    every = saved(rows.select(F.col("id").alias("doc_id"), "key").join(of_key, "key"), "rows", shrink=2)
    several = saved(every.groupBy("doc_id").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y and doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("_several")), "several", shrink=8)
    lead = F.struct("doc_id", "key")
    told = every.join(small(several, several.count()), "doc_id", "left")
    best = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull() & F.col("_several").isNull(), lead)), F.min(F.when(F.col("doc_id").isNotNull(), lead)), F.min(lead))
    names = told.groupBy("root").agg(best.alias("_best")).select("root", F.col("_best.doc_id").alias("class_id"), F.col("_best.key").alias("lead"))
    return every, saved(names, "names", shrink=4)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, class_id) of every row: the least doc_id of its near-duplicate class."""
    rows, names = named(docs, similarity)
    return rows.join(names, "root").select("doc_id", "key", "class_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that with the class's id; of repeated rows one."""
    texts, columns = covered(docs)
    rows, names = named(docs, similarity)
    kept = rows.join(names, "root").where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("lead"))).groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    kept = saved(kept.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n"), "kept", shrink=4)
    text = F.col(columns["text"])
    same = F.col(columns["doc_id"]).eqNullSafe(F.col("_id")) & (node_key(text, words_of(text)) == F.col("_key"))
    once, often = kept.where("n = 1"), kept.where("n > 1")
    out = texts.join(once.hint("merge"), same, "left_semi")  # at any size, as its rows grow with the texts
    if not often.isEmpty():
        again = texts.join(often, same).groupBy("_id", "_key").agg(F.first(F.struct(*texts.columns)).alias("_row"))
        out = out.unionByName(again.select("_row.*"))
    return uncovered(out, columns)


def op10_near_dup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
