"""Cases that operators once got wrong: white space without end, marks and words without end, names that tell of a layout, texts without ids."""

import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, fingerprint, html_extract, neighbours, substring_dedup, token_store

# 4

PASSAGE = "Alpha beta gamma delta. Epsilon zeta eta theta iota! Kappa lambda mu nu xi?"


def test_texts_without_or_with_shared_ids_are_documents(spark):
    rows = [(None, f"{PASSAGE} One end here."), (None, f"{PASSAGE} Another end there."), (5, f"{PASSAGE} Third."), (5, f"{PASSAGE} Fourth one."), (5, f"{PASSAGE} Fourth one."), (-3, f"{PASSAGE} Fifth.")]
    got = [(r["doc_id"], r["text"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    kept = [g for g in got if "Alpha" in g[1]]
    assert len(got) == len(rows) and len(kept) == 1 and kept[0][0] is None
    without = [(i, t) for i, t in rows if i is not None]
    kept = [(r["doc_id"], r["text"]) for r in substring_dedup.dedup(spark.createDataFrame(without, "doc_id long, text string")).collect() if "Alpha" in r["text"]]
    assert [i for i, _ in kept] == [-3]
    twice = [without[1], without[2]]  # equal rows are one document and keep it
    assert all("Alpha" in r["text"] for r in substring_dedup.dedup(spark.createDataFrame(twice, "doc_id long, text string")).collect())


def test_long_passages_without_ids_stay_once(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(None, f"x{i} and y{i} {words} z{i}") for i in range(4)] + [(9, f"a b c {words} d"), (9, f"e f {words} g h")]
    got = [r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum("w40" in t for t in got) == 1 and len(got) == 6


# 5

ARTICLE = "<p>" + "The article has a long text of many words, and it goes on. " * 5 + "</p>"
NAV, FOOT = "<nav><a href=x>Menu one</a><a href=y>Menu two</a></nav>", "<footer>Foot of the page</footer>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div><svg class='i'/>{ARTICLE * 3}</div>", f"<div><svg viewBox='0 0 1 1' />{ARTICLE * 3}</div>", f"<div><svg>{ARTICLE * 3}</div>", f"<div>{ARTICLE}<math/>{ARTICLE * 2}</div>", f"<div><math><mi>Inner</mi></math>{ARTICLE * 3}</div>",
        f"<div><svg><svg><title>t</title></svg><text>Inner</text></svg>{ARTICLE * 3}</div>", f"<div class='content has-sidebar'>{ARTICLE * 3}</div><div class='sidebar'><p>Side words here.</p></div>", f"<div class='no-sidebar page'>{ARTICLE * 3}</div>",
        f"<div id='page-without-menu' class='without-menu'>{ARTICLE * 3}</div>", f"<div class='page'>{ARTICLE.replace('<p>', '<p class=search-results>') * 3}</div>", f"<div class='search-results-list'>{ARTICLE * 3}</div>", f"<div class='widget'>{ARTICLE * 3}</div>",
        f"<div class='widget widget-text'>{ARTICLE * 3}</div><div class='widget'><p>Side words here.</p></div>", f"<div class='promo related'>{ARTICLE * 3}</div>",
    ],
)
def test_the_article_stays(body):
    text = html_extract.main_text(f"<html><body>{NAV}{body}{FOOT}</body></html>")
    assert text.count("article") == 15 and not any(w in text for w in ("Menu", "Foot", "Side", "Inner"))


@pytest.mark.parametrize("name", ["cookie-notice", "main-menu", "footer", "search-form", "site-search", "search", "sidebar", "left-sidebar", "newsletter-signup", "ad", "ads top", "comments", "comment-list", "breadcrumbs", "related-posts", "share-buttons"])
def test_what_is_no_article_goes(name):
    other = "<p>" + "These other words stand beside it, and are told at some length. " * 4 + "</p>"
    text = html_extract.main_text(f"<html><body>{NAV}<div class='{name}'>{other}</div><div>{ARTICLE * 2}</div><div id='{name}'>{other}</div>{FOOT}</body></html>")
    assert text.count("article") == 10 and "other" not in text


def test_long_comments_go():
    remarks = ARTICLE.replace("article", "remark") * 9
    text = html_extract.main_text(f"<html><body><div>{ARTICLE}</div><section class='comments'>{remarks}</section></body></html>")
    assert text.count("article") == 5 and "remark" not in text


@pytest.mark.parametrize("part", ["<a", "<svg ", "<svg>", "<svg/>", '<a "', "<!--", "<div>", "<!x", "<", "<script>", "<p class=sidebar>", "</svg>", "<math><svg></math>"])
def test_hostile_pages_take_linear_time(part):
    began = time.perf_counter()
    for page in (part * 60_000, part * 60_000 + ">"):
        html_extract.main_text(page)
    assert time.perf_counter() - began < 15


def test_what_never_ends():
    assert html_extract.main_text("<p>a</p><!-- never <p>b</p>") == "a" and html_extract.main_text("<p>a</p><!-- never") == "a"
    assert html_extract.main_text("<p>a</p><script>never <p>b</p>") == "a" and html_extract.main_text("<p>a <") == "a <"


# 6


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_long_words_merge_as_short_ones():
    v, rng = bpe.vocabulary(bpe.default_path()), random.Random(2)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for letters in ("etaoinshr", "a", "ab", "=-", "漢字日本", "\x01é😀") for _ in range(300)]
    assert [v.merged_long(w.encode()) for w in words] == v.merged(words)


@pytest.mark.parametrize(("letters", "n"), [("etaoinshrdlu", 1_000_000), ("a", 400_000), ("ab", 300_001), ("=-_!.", 200_000), ("漢字日本語", 100_000)])
def test_a_word_without_end(library, letters, n):
    rng = random.Random(n)
    text = "short words " + "".join(rng.choice(letters) for _ in range(n)) + " and more"
    coder, began = bpe.Encoder.of(bpe.vocabulary(bpe.default_path())), time.perf_counter()
    found = next(coder.encode([text])).tolist()
    assert time.perf_counter() - began < 30
    assert found == library.encode(text, add_special_tokens=False).ids


def test_marks_in_pairs(library):
    rng = random.Random(6)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    newer = [chr(c) for c in (0x7FD, 0x8D2, 0xD3B, 0x10F4E)]
    letters = [*marks, *newer * 20, *"̴ֱ́ͅ" * 60, *"abcAZ09 ." * 40, "é", "가", "ᆨ", "Σ", "ﬁ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(100_000)] + [f"a{x}{y}" for x in newer for y in marks] + [f"a{y}{x}" for x in newer for y in marks]
    coder = bpe.Encoder.of(bpe.vocabulary(bpe.default_path()))
    found = [x.tolist() for i in range(0, len(texts), 5000) for x in coder.encode(texts[i : i + 5000])]
    assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_the_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 100_000)
    coder = bpe.Encoder(bpe.vocabulary(bpe.default_path()))
    for k in range(20):
        list(coder.encode([f"{k}" + "x" * 30_000, " ".join(f"w{k}y{i}" for i in range(50))]))
        assert sum(map(len, coder.cache)) < 200_000


# 7


def test_buckets_beyond_what_a_plan_holds(spark, monkeypatch):
    rows = [(i * 7 % 1000, f"text {i} " * (i % 5)) for i in range(300)] + [(None, "x"), (None, "y"), (5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r["doc_id"], r["_text"], r["_edited"]) for r in fingerprint.edited_pairs(docs).where("not _ghost").collect()}
    monkeypatch.setattr(neighbours, "MOST_CUTS", 4)
    monkeypatch.setattr(neighbours, "BUCKET_BYTES", 100)
    pairs = fingerprint.edited_pairs(docs)
    assert {(r["doc_id"], r["_text"], r["_edited"]) for r in pairs.where("not _ghost").collect()} == want and len(want) == 303
    per = pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("_bucket").alias("n")).collect()
    assert {r["n"] for r in per} == {1} and len(per) > 30
    monkeypatch.setattr(neighbours, "BUCKET_BYTES", 10)
    size = lambda p: len(p._jdf.queryExecution().optimizedPlan().toString())
    assert size(fingerprint.edited_pairs(docs)) < 1.2 * size(pairs)
    assert fingerprint.edited_pairs(docs.where("doc_id < 0")).count() == 0
    alone = fingerprint.edited_pairs(docs.where("doc_id = 5000")).where("not _ghost").first()
    assert alone["_edited"] == "z"


# 8

BLANKS = [" " * 2_000_000, "\n" * 2_000_000, " \n\t　" * 400_000, "a" + " " * 2_000_000 + "b", "a" + "\n" * 1_000_000 + "<|endoftext|>" + " " * 200_000 + "x", " " * 150_000 + "\x1c" + " " * 150_000, "x  " + "\r\n" * 300_000 + "'s" + " " * 100_000 + "9"]


@pytest.fixture(scope="module")
def bytes_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_white_space_without_end(spark, tmp_path, bytes_library):
    path = f"file://{tmp_path}/store"
    token_store.write(spark.createDataFrame(list(enumerate(BLANKS)), "doc_id long, text string"), path)
    found = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in token_store.documents(spark, path).collect()}
    assert found == {i: [*bytes_library.encode(t, add_special_tokens=False).ids, token_store.END_ID] for i, t in enumerate(BLANKS)}


def test_runs_cut_out_of_texts(monkeypatch, bytes_library):
    monkeypatch.setattr(token_store, "LONG_RUN", 3)
    encode, rng = token_store.IdEncoder(*token_store.vocabulary()), random.Random(8)
    letters = [" ", " ", "\n", "\t", "　", "\x1c", "\x85", "a", "é", "9", "<|endoftext|>", "'s", "!", "漢", "​", "😀", "\xa0", " x"]
    texts = ["".join(rng.choice(letters) * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    assert [encode(t).tolist() for t in texts] == [e.ids for e in bytes_library.encode_batch(texts, add_special_tokens=False)]
