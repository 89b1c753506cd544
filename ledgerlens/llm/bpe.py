"""Byte-pair encoding and decoding in batched numpy merge rounds.

The distinct new words of an Arrow batch become one flat array of symbols. A round looks all neighbouring pairs up by binary
search over the sorted pair keys, takes the lowest rank in each word, and merges every place that has it; words without a
known pair leave the array. A word of more than ``LONG_WORD`` symbols gets an array of its own, in which ranks are kept between rounds
and only pairs beside merged places are looked up again, so that a round costs what it merges. Ids of words seen before come from
a cache that is bounded by bytes. Documents never leave their partition.

Edge cases: null and empty texts have no ids and decode to the empty text; repeated rows encode alike; texts of any length are
encoded whole; the strings of added tokens within a text become their ids; other columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_batches, table

#: Bytes of the cache, with about ``ENTRY_BYTES`` for the objects of an entry.
CACHED_BYTES, ENTRY_BYTES = 60 << 20, 200
LONG_WORD = 2000
#: Symbols of one merge call; longer batches of new words are cut, a single longer word is not.
FLAT_SYMBOLS = 200_000

#: White space as the vocabulary's normaliser and pre-tokeniser see it (fixed values of Unicode's White_Space).
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = re.escape(SPACES)
SEPARATORS = re.compile("[\x1c-\x1f]")
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Vocabulary:
    """Sorted pair keys, ranks and ids of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.encoder: Encoder | None = None
        self.kinds = Letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in chain(ids.items(), self.added.items()):
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([ids.get(c, -1) for c in letters], np.int64)
        self.last = np.array([ids.get(c + self.end, -1) for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def merged_long(self, raw: bytes) -> bytes:
        """The ids of one long word: places wait by the rank of their pair, the lowest rank first, in a linked list of symbols."""
        flat = np.frombuffer(raw, np.uint8)
        symbols = self.inner[flat]
        symbols[-1] = self.last[flat[-1]]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, NO_RANK, np.int32)  # of the pair that begins at a place
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            found = self.ranked(symbols[places], symbols[after[places]])
            rank[places] = found
            places, found = places[found != NO_RANK], found[found != NO_RANK]
            order = np.argsort(found, kind="stable")
            found, firsts = np.unique(found[order], return_index=True)
            for r, part in zip(found.tolist(), np.split(places[order], firsts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heappush(queue, r)
                waiting[r].append(part)

        wait(np.arange(n - 1))
        while queue:
            r = heappop(queue)
            parts = waiting.pop(r)
            places = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            places = places[rank[places] == r]
            if not len(places):
                continue
            # of a run of overlapping places every second one merges, from the left
            fresh = np.append(True, after[places[:-1]] != places[1:])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            gone = after[places]
            symbols[places] = self.made[r]
            symbols[gone] = -1
            rank[gone] = rank[places] = NO_RANK
            after[places] = after[gone]
            inner = after[places] < n
            before[after[places[inner]]] = places[inner]
            left = before[places]
            wait(np.unique(np.concatenate([left[left >= 0], places[inner]])))
        return symbols[symbols >= 0].astype(np.int32).tobytes()

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word (not empty), as 32-bit integers."""
        raw = [w.encode("utf-8", "replace") for w in words]
        if any(len(w) > LONG_WORD for w in raw):
            rest = iter(self.merged([w for w, r in zip(words, raw, strict=True) if len(r) <= LONG_WORD]))
            return [self.merged_long(r) if len(r) > LONG_WORD else next(rest) for r in raw]
        if not raw:
            return []
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        done_owner, done_symbols = [], []
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            ranks = np.append(np.where(inside, self.ranked(symbols[:-1], symbols[1:]), NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, ~inside))
            lowest = np.minimum.reduceat(ranks, starts)
            width = np.diff(np.append(starts, len(symbols)))
            least = np.repeat(lowest, width)
            live = least != NO_RANK
            if not live.all():
                done_owner.append(owner[~live])
                done_symbols.append(symbols[~live])
                symbols, owner, ranks, least = symbols[live], owner[live], ranks[live], least[live]
                if not len(symbols):
                    break
            hit = ranks == least
            places = np.flatnonzero(hit)
            # of a run of overlapping places (a a a) every second one merges, from the left
            fresh = np.append(True, np.diff(places) > 1)
            run = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]
            places = places[(places - run) % 2 == 0]
            symbols[places] = self.made[least[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        symbols = symbols[order].astype(np.int32).tobytes()
        cuts = np.concatenate(([0], 4 * np.cumsum(np.bincount(owner, minlength=len(raw))))).tolist()
        return [symbols[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


#: Combining marks of the lowest and the highest class.
LOW_MARK, HIGH_MARK = "\u0334", "\u0345"
#: Code points that the letter tables are made of at a time.
LETTER_BLOCK = 4096


class Letters:
    """What counts as a letter or digit, lower case where the interpreter's Unicode version differs, and the code points in ``odd`` beside which NFC may differ, as the tokenizers library has them.

    The code points are looked at block by block, so that no more than one block's strings are held. NFC of a text without odd ones is the
    same in both: they compose alike, alone and from their parts, and are marks of the same order, which shows beside a mark of a low
    and of a high class.
    """

    def __init__(self) -> None:
        from tokenizers import Regex, normalizers, pre_tokenizers

        splits = [pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True) for kind in "LN"]
        low, nfc = normalizers.Lowercase(), normalizers.NFC()
        found: list[list[list[int]]] = [[], []]
        self.lower: dict[int, str] = {}
        odd: set[int] = set()
        for first in range(0, sys.maxunicode + 1, LETTER_BLOCK):
            points = [c for c in range(first, first + LETTER_BLOCK) if not 0xD800 <= c < 0xE000 and c != 10]
            if not points:
                continue
            chars = list(map(chr, points))
            text = "".join(chars)
            for runs, split in zip(found, splits, strict=True):
                for _, (a, b) in split.pre_tokenize_str(text):
                    if runs and runs[-1][1] + 1 == points[a]:
                        runs[-1][1] = points[b - 1]
                    else:
                        runs.append([points[a], points[b - 1]])
            lines = "\n".join(chars)
            self.lower |= {c: x for c, x in zip(points, low.normalize_str(lines).split("\n"), strict=True) if x != chr(c).lower()}
            for make in (str, lambda x: unicodedata.normalize("NFD", x), lambda x: f"a{HIGH_MARK}{x}", lambda x: f"a{x}{LOW_MARK}", lambda x: f"a{LOW_MARK}{HIGH_MARK}{x}{LOW_MARK}"):
                shown = "\n".join(map(make, chars))
                theirs, ours = nfc.normalize_str(shown), unicodedata.normalize("NFC", shown)
                if theirs != ours:
                    odd |= {c for c, x, y in zip(points, theirs.split("\n"), ours.split("\n"), strict=True) if x != y}
        self.odd = re.escape("".join(map(chr, sorted(odd))))
        self.letters, self.digits = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) for runs in found)


class Encoder:
    """Encodes texts with a vocabulary. No pattern crosses white space, so that what stands between it is encoded once and kept in a bounded cache."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cache: dict[str, bytes] = {}
        self.held = 0
        letters, digits = vocabulary.kinds.letters, vocabulary.kinds.digits
        self.lower = vocabulary.kinds.lower | {ord("Σ"): "σ"}  # letter by letter, so that a final sigma gets no form of its own
        self.odd = re.compile(f"[{vocabulary.kinds.odd}]" if vocabulary.kinds.odd else r"(?!)")
        self.nfc = None
        self.word = re.compile(rf"[{letters}]+|[{digits}]|'s|'t|'re|'ve|'m|'ll|'d|[^{SPACE}{letters}{digits}]+")
        self.heads = {t[:2] for t in self.v.added}  # what a text must contain for an added token to be looked for
        self.special = re.compile("|".join(map(re.escape, sorted(self.v.added, key=len, reverse=True))) or r"(?!)")

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Encoder:
        """The encoder of a vocabulary, kept as long as the Python worker has that."""
        if vocabulary.encoder is None:
            vocabulary.encoder = cls(vocabulary)
        return vocabulary.encoder

    def composed(self, text: str) -> str:
        if not self.odd.search(text):
            return unicodedata.normalize("NFC", text)
        if self.nfc is None:
            from tokenizers import normalizers

            self.nfc = normalizers.NFC()
        return self.nfc.normalize_str(text)

    def chunks(self, text: str) -> list[str]:
        """What stands between white space, in NFC and lower case."""
        if not text.isascii():
            text = self.composed(text).translate(self.lower)
        text = text.lower()
        if SEPARATORS.search(text):  # white space to str.split(), but not to the vocabulary
            return re.split(f"[{SPACE}]+", text.strip(SPACES))
        return text.split()

    def pieces(self, text: str) -> list[str | bytes]:
        if not any(h in text for h in self.heads) or not self.special.search(text):
            return self.chunks(text)
        out: list[str | bytes] = []
        at = 0
        for m in self.special.finditer(text):
            out += [*self.chunks(text[at : m.start()]), np.int32(self.v.added[m[0]]).tobytes()]
            at = m.end()
        return out + self.chunks(text[at:])

    def learn(self, chunks: Iterable[str | bytes]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.cache and isinstance(c, str)]
        cut = [self.word.findall(c) for c in new]
        words: dict[str, bytes] = dict.fromkeys(chain.from_iterable(cut), b"")
        part, size = [], 0
        for w in list(words):
            part.append(w)
            size += len(w)
            if size >= FLAT_SYMBOLS:
                words.update(zip(part, self.v.merged(part), strict=True))
                part, size = [], 0
        if part:
            words.update(zip(part, self.v.merged(part), strict=True))
        for c, own in zip(new, cut, strict=True):
            self.cache[c] = found = words[own[0]] if len(own) == 1 else b"".join(map(words.__getitem__, own))
            self.held += ENTRY_BYTES + len(c) + len(found)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        cut = [self.pieces(t or "") for t in texts]
        if self.held > CACHED_BYTES:
            self.cache.clear()
            self.held = 0
        self.learn(chain.from_iterable(cut))
        get = self.cache.__getitem__
        for chunks in cut:
            try:
                found = b"".join(map(get, chunks))
            except KeyError:  # ids of added tokens stand for themselves
                found = b"".join(c if isinstance(c, bytes) else get(c) for c in chunks)
            yield np.frombuffer(found, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with blanks between them: the vocabulary file names no decoder."""
        return " ".join(map(self.v.tokens.__getitem__, ids.tolist()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file, made once a process."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids array<int> and decoded string of every row."""
    spark = docs.sparkSession
    python_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path or default_path()))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            ids = list(coder.encode(texts))
            offsets = pa.array(np.concatenate(([0], np.cumsum(list(map(len, ids))))), pa.int32())
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))), pa.array(map(coder.decode, ids), pa.string())], ["k", "ids", "decoded"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, ids array<int>, decoded string").withColumnRenamed("k", key)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return digests(encode_decode(table(spark, sf_dir, "documents")))
