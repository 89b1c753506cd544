"""Each operator against a brute-force version, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, components, decontaminate, fingerprint, html_extract, near_dup, pii, quality, substring_dedup, token_store, warc
from ledgerlens.llm.common import work_path
from ledgerlens.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_words long, score string, ids int"
LONG = " ".join(f"word{i}" for i in range(40_000))
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "One two."), (4, "One two."), (None, "No id here, a@b.co."), (5, "!!! ???"), (6, LONG), (7, "é😀 naïve <|endoftext|> Σας ΟΔΟΣ"), (8, "x" * 50_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 5, "s", 9) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1


def hit_words(text, grams):
    w, hit, items = words(text), set(), set()
    for n in {len(g) for g in grams}:
        for k in range(len(w) - n + 1):
            if found := grams.get(tuple(w[k : k + n])):
                items |= found
                hit |= set(range(k, k + n))
    return len(w), len(hit), sorted(items)


def grams_of(items):
    out = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    return out


def test_contamination_equals_brute_force(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    grams = grams_of(bench)
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert found == {i: hit_words(t, grams) for i, t in texts(spark, sf).items()}


def test_contamination_of_odd_rows(spark, odd, none):
    items = [(1, "One TWO"), (2, None), (3, ""), (4, LONG[:200]), (5, "two one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(odd, bench).collect()
    assert len(rows) == len(ODD)
    grams = grams_of(items)
    expected = {i: hit_words(t, grams) for i, t in ODD}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows} == expected
    assert decontaminate.contamination(none, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(odd, bench.limit(0)).collect())
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in ODD if not expected[i][1])
    cut = by_id(decontaminate.decontaminate(odd, bench, mode="span"))
    assert cut[4]["text"] == "." and cut[2]["text"] == "" and cut[1]["text"] is None
    assert cut[6]["text"].startswith("word" + str(len(words(LONG[:200])))[:1]) and len(words(cut[6]["text"])) == 40_000 - expected[6][1]


def test_hits_read_documents_once(spark, odd, monkeypatch):
    """Items of 1 to 11 words: one scan and one lookup of the documents' windows, whose rows hold no words."""
    items = [(k, " ".join(f"word{k * 100 + i}" for i in range(k))) for k in range(1, 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = decontaminate.benchmark_windows(bench).cache()
    assert {r["_len"] for r in grams.collect()} == set(range(1, 11))
    expected = {i: hit_words(t, grams_of(items)) for i, t in ODD}
    for rows in (10**6, 0):
        monkeypatch.setattr("ledgerlens.llm.common.BROADCAST_ROWS", rows)
        found = decontaminate.places(odd, grams, list(range(1, 11)))
        assert found.columns == ["doc_id", "_th", "_at", "_len", "_hash"]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and plan.count("LogicalRDD") <= 1
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(odd, bench).collect()} == expected


def test_clashing_columns(spark):
    """Columns named like the operators' own come back as they were."""
    names = ["_th", "_cuts", "_gone", "_id", "_own", "_spans", "_near_key", "_bad_id", "_text", "_words", "key", "root", "class_id", "lead", "c0", "r", "m", "t"]
    rows = [(1, "One two three four five six seven a@b.co eight nine ten.", *range(18)), (2, None, *range(18)), (3, "Other words here.", *range(18))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{x} int" for x in names))
    bench = spark.createDataFrame([(1, "never seen")], "item_id long, text string")
    for made in (decontaminate.decontaminate(docs, bench), decontaminate.decontaminate(docs, bench, mode="span"), substring_dedup.dedup(docs), near_dup.drop_near_duplicates(docs)):
        assert made.columns == docs.columns and sorted(map(tuple, made.collect())) == rows
    clean = by_id(pii.sanitise(docs))
    assert clean[1]["text"] == rows[0][1].replace("a@b.co", "[EMAIL]") and clean[3]["_spans"] == 5


# 2


def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    scored = QUERIES["op2_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    good = [r["score"] for r in scored if r["quality"] == 1]
    bad = [r["score"] for r in scored if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.9


def test_forward_backward_equals_enumeration():
    random = np.random.default_rng(0)
    e, t = random.normal(size=5), random.normal(size=(2, 2))
    lines = np.array([3, 2])
    good, pairs = quality.marginals(e, t, lines)
    expected, joint = np.zeros(5), np.zeros((2, 2))
    for first, n in ((0, 3), (3, 2)):
        total, own, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in np.ndindex(*([2] * n)):
            w = np.exp(sum(e[first + i] * y for i, y in enumerate(labels)) + sum(t[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            total += w
            own += w * np.array(labels)
            for a, b in zip(labels, labels[1:], strict=False):
                two[a, b] += w
        expected[first : first + n] = own / total
        joint += two / total
    assert np.allclose(good, expected) and np.allclose(pairs, joint)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, None), (None, 0)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)  # one kind of label: every score is 0.5
    assert quality.keep_good(none, quality.train(none, labels.limit(0))).count() == 0
    assert np.all((model.scores(["", "a\n\nb", LONG]) >= 0) & (model.scores(["", "a\n\nb", LONG]) <= 1))


def line_facts(line):
    """The features of one line, in words of the docstring of ``quality.line_features``."""
    counts = [0] * 9
    for c in line:
        counts[int(quality.KINDS[min(ord(c), len(quality.KINDS) - 1)])] += 1
    w = line.split()
    n, k = max(len(line), 1), max(len(w), 1)
    again = sum(a == b for a, b in zip(w, w[1:], strict=False))
    odd_marks = counts[quality.SYMBOL] + counts[quality.BANG] + counts[quality.PIPE]
    return [5 * c / n for c in counts] + [again / k, min((len(line) - counts[quality.SPACE]) / k, 20) / 10, np.log1p(len(line)) / 5, min(len(w), 5) / 5, min(odd_marks / k, 3)]


def test_scores_equal_brute_force(spark):
    """Every line labelled in all ways: marginals by enumeration, their mean by length, the logistic curve."""
    random = np.random.default_rng(9)
    model = quality.Model(random.normal(size=1 + 3 * quality.BASE), random.normal(size=(2, 2)), 3.0, -1.0)
    found = ["", "One line only.", "Good good words.\n\n| a | b |!!!", "x\ny y y\n\u00e9t\u00e9 2024\nEND", None]
    want = []
    for text in found:
        lines = (text or "").split("\n")
        x = [line_facts(t) for t in lines]
        zero = [0.0] * quality.BASE
        e = [float(np.dot(model.weights, [1, *x[i], *(x[i - 1] if i else zero), *(x[i + 1] if i + 1 < len(x) else zero)])) for i in range(len(x))]
        total, good = 0.0, np.zeros(len(x))
        for labels in np.ndindex(*([2] * len(x))):
            w = np.exp(sum(e[i] * y for i, y in enumerate(labels)) + sum(model.transition[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            total += w
            good += w * np.array(labels)
        weight = np.array([len(t) + 1 for t in lines])
        want.append(1 / (1 + np.exp(-(model.scale * float((good / total * weight).sum() / weight.sum()) + model.offset))))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id long, text string")
    scored = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.score(model, F.col("text")).alias("s")).collect()}
    assert np.allclose([scored[i] for i in range(len(found))], want, atol=1e-9)


def test_training_is_bounded_and_repeatable(spark):
    rows = [(i, f"Line {i} of some text." if i % 2 else f"!!! ||| {i} ###") for i in range(40)] + [(3, "Another text under the same id.")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    made = [quality.train(spark.createDataFrame(r, "doc_id long, text string").repartition(4), labels) for r in (rows, rows[::-1])]
    assert np.array_equal(made[0].weights, made[1].weights) and made[0].scale == made[1].scale
    long = spark.createDataFrame([(i, "a\n" * 300) for i in range(40)], "doc_id long, text string")
    assert quality.train(long, labels).scale == 0.0


# 3

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    total = sum(d - 9 if d > 9 else d for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
    return {"email": True, "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, k in enumerate(BASE) for m in re.finditer(BASE[k], text or "") if valid(k, m[0])]
    return ",".join(x[2] for x in sorted(found))


def test_base_spans_equal_the_patterns(spark, sf):
    found = {r["doc_id"]: r for r in QUERIES["op3_pii"](spark, sf).collect()}
    for i, t in texts(spark, sf).items():
        assert found[i]["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest()


TRICKY = [
    "a@b.com_x@y.com", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824 +44 20 7946 0958",
    "x" * 3000 + "@" + "y" * 3000, "1" * 50_000, "é😀 a@b.co 😀 +1 743 555 3824", "1.2.3.4@5.6.7.8", "@@a@a.b@c.d", None, "", "+1 555 123 4567 8901 2345", " - ".join(["1 2"] * 2000),
]


def test_base_spans_of_odd_texts(spark, none):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)] + [(0, TRICKY[0])], "doc_id long, text string")
    found = {r["doc_id"]: ",".join(f"{pii.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["_spans"]) for r in pii.per_document(pii.spans(docs)).collect()}
    assert {i: found.get(i, "") for i in range(len(TRICKY))} == {i: base_spans(t) for i, t in enumerate(TRICKY)}
    clean = pii.sanitise(docs)
    assert clean.count() == len(TRICKY) + 1 and by_id(clean)[9]["text"] == "[EMAIL]" and by_id(clean)[11]["text"] is None
    assert pii.sanitise(none).columns == none.columns and pii.sanitise(none).count() == 0


def test_disclosing_terms_are_spans(spark):
    lines = [f"Report {i}: the manager zanzibor wrote from +1 (743) 555-3824 about matter {'abcdefghij'[i]}{i}." for i in range(6)]
    rows = [(i, t) for i, t in enumerate(lines)] + [(10 + i, f"The manager wrote about the matter report {i}.") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.spans(docs)
    found = {(r["doc_id"], rows[r["doc_id"]][1][r["_start"] : r["_end"]]) for r in spans.where("kind = 4").collect() if r["doc_id"] < 6}
    assert {w for _, w in found} >= {"zanzibor"} and not {w for _, w in found} & {"manager", "matter", "the"}
    assert not spans.where("kind = 4 and doc_id >= 10").count()
    assert "zanzibor" not in by_id(pii.sanitise(docs))[0]["text"]


def test_words_at_the_edge_of_a_context_are_whole(spark):
    pad = "filler " * 11
    docs = spark.createDataFrame([(1, f"smart {pad}a@b.co {pad}trams")], "doc_id long, text string")
    around = pii.base_spans(docs).first()["around"]
    assert set(re.findall(r"\w+", around)) <= {"filler"} and "filler" in around


def test_disclosure_equals_brute_force(spark):
    """n(e, t) in different contexts, n(t), Wilson's lower bound and its bits, counted by hand."""
    random = np.random.default_rng(3)
    names = [f"name{'abcdefgh'[i]}" for i in range(8)]
    rows = []
    for i in range(120):
        e = int(random.integers(0, 4))
        near = names[e] if random.random() < 0.9 else names[int(random.integers(0, 8))]
        rows.append((i, f"{near} sent {'abcdefghij'[i % 10] * 3} to user{e}@site.org about {'klmnopqrst'[i % 7] * 4}." if i % 3 else f"{names[int(random.integers(0, 8))]} alone with words."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.base_spans(docs).collect()
    total, contexts, together = Counter(), {}, Counter()
    for _, t in rows:
        total.update(re.findall(r"[^\W\d_]{3,}", t.lower()))
    for r in spans:
        for w in re.findall(r"[^\W\d_]{3,}", r["around"].lower()):
            contexts.setdefault((r["match"], w), set()).add(r["around"].lower())
            together[r["match"], w] += 1
    want = set()
    for (e, w), c in contexts.items():
        n, z = len(c) + max(0, total[w] - together[e, w]), pii.Z
        p = len(c) / n
        low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        if low >= 2**-pii.BITS:
            want.add((e, w, len(c), total[w]))
    found = pii.disclosing_terms(docs, pii.base_spans(docs))
    assert {tuple(r) for r in found.collect()} == want and 0 < len(want) < len(contexts)


# 4

SOLID = re.compile(r"[^ \t\n\x0b\f\r]+")


def sentences(text):
    """The words of a text in lower case, and which begin a sentence."""
    found = list(SOLID.finditer(text))
    opens, count = [], 0
    for i, m in enumerate(found):
        new = i == 0 or found[i - 1][0][-1] in ".!?" or "\n" in text[found[i - 1].end() : m.start()]
        count = 0 if new else count + 1
        opens.append(new or count % 16 == 0)
    return SOLID.findall(text.lower()), opens


def without_repeats(rows):
    """{id: (text, sentences touched)}: what the docstring of the operator says, place by place."""
    docs = {i: sentences(t or "") for i, t in rows}
    order = sorted(docs, key=lambda i: (i is not None, i or 0))
    removed, seen, windows = {i: set() for i in docs}, {}, {}
    for i in order:
        w, opens = docs[i]
        edge = [k for k, o in enumerate(opens) if o] + [len(w)]
        n = len(edge) - 1
        for a in range(max(0, n - 3) + 1 if n else 0):
            b = min(a + 3, n)
            while b < n and edge[b] - edge[a] < 8:
                b += 1
            if edge[b] - edge[a] >= 8:
                key = tuple((x, opens[k]) for k, x in enumerate(w[edge[a] : edge[b]], edge[a]))
                if seen.setdefault(key, (i, a)) != (i, a):
                    removed[i] |= set(range(edge[a], edge[b]))
    left = {i: set(range(len(docs[i][0]))) - removed[i] for i in docs}
    for i in order:
        w = docs[i][0]
        for k in range(len(w) - 50):
            if windows.setdefault(tuple(w[k : k + 51]), (i, k)) != (i, k) and left[i] >= set(range(k, k + 51)):
                removed[i] |= set(range(k, k + 51))
    out = {}
    for i, t in rows:
        ends = [m.end() for m in SOLID.finditer(t or "")]
        edges = [0, *ends[:-1], len(t or "")]
        kept = "".join((t or "")[a:b] for k, (a, b) in enumerate(zip(edges, edges[1:])) if k not in removed[i])
        unit = np.cumsum(docs[i][1])
        out[i] = (kept.lstrip(" ") if removed[i] else t, len({unit[k] for k in removed[i]}))
    return out


def test_repeated_sentences_equal_brute_force(spark, sf):
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in QUERIES["op4_substring_dedup"](spark, sf).collect()}
    assert found == without_repeats(texts(spark, sf).items())


def test_repeated_sentences_of_odd_rows(spark, odd, none):
    passage = "Alpha beta gamma delta. Epsilon zeta eta theta iota! Kappa lambda mu nu xi?"
    rows = [(1, f"{passage} Own end."), (2, f"Start. {passage}\nTail here."), (3, None), (4, "")]
    found = by_id(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True))
    assert {i: (r["text"], r["n_removed"]) for i, r in found.items()} == without_repeats(rows) and found[2]["text"] == "Start.\nTail here."
    kept = substring_dedup.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) and [r["text"] for r in kept.where("doc_id = 4").collect()] == ["One two."] * 2
    assert substring_dedup.dedup(none).count() == 0


def test_repeated_short_sentences_are_found(spark):
    junk = " ".join(f"W{i}!!" for i in range(60))
    rows = [(1, f"{junk} Own end."), (2, f"Start here. {junk}\nTail."), (3, "A. B. C. D."), (4, "A. B. C. D."), (5, f"{junk} {junk}")]
    found = by_id(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True))
    assert {i: (r["text"], r["n_removed"]) for i, r in found.items()} == {1: (rows[0][1], 0), 2: ("Start here.\nTail.", 60), 3: ("A. B. C. D.", 0), 4: ("A. B. C. D.", 0), 5: ("", 120)}


def test_passages_are_found_wherever_they_begin(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"Own start {passage} tail one. More of it."), (2, f"Here three other words {passage} and another end. Last."), (3, passage[:-4]), (4, "  ".join(passage.split()[5:55]) + "."), (5, f"x\u00a0y {passage.upper()}\u2003z \n")]
    found = by_id(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True))
    assert {i: r["text"] for i, r in found.items()} == {1: rows[0][1], 2: "Here three other words and another end. Last.", 3: "", 4: rows[3][1], 5: "x\u00a0y W59\u2003z \n"}
    assert {i: (r["text"], r["n_removed"]) for i, r in found.items()} == without_repeats(rows)
    assert [found[i]["n_removed"] > 0 for i in range(1, 6)] == [False, True, True, False, True]


def test_no_passage_is_kept_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen = {}
    for i, r in sorted(by_id(substring_dedup.dedup(docs)).items()):
        w = (r["text"] or "").lower().encode().split()
        for k in range(len(w) - 50):
            assert seen.setdefault(tuple(w[k : k + 51]), (i, k)) == (i, k)


# 5

PAGE = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies to track all of what you do here, my friend.</div>
<div id="content"><div class="post"><h2>Title &amp; more</h2><p>First paragraph with  text &lt;here&gt; that is long enough.<p>Second, <b>bold</b> and <a href=y>link</a>.<ul><li>one<li>two</ul></div>
<div class="comments"><p>I disagree at length with what was written above, as I always do.</p></div></div><form><input><textarea>abc</textarea></form><script>if (a<b) {"</p>"}</script><footer>c</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst paragraph with text <here> that is long enough.\nSecond, bold and link.\none\ntwo"
    assert html_extract.main_text("<article><header><h1>A title of some words</h1></header><p>b and its sentence<br>c and its own</article><p>d") == "A title of some words\nb and its sentence\nc and its own"
    assert [html_extract.main_text(x) for x in (None, "", "just &eacute; text", "<p>a<p>b", "<nav>a</nav>", "<<<")] == ["", "", "just é text", "a\nb", "", "<<<"]
    assert html_extract.main_text("<div>" * 5000 + "x") == "x"


def test_pages_equal_their_articles(spark, sf):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op5_html_extract"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"<(?:p|/p|br|h1|/h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    rows = spark.createDataFrame([(1, "u", None, 1), (1, "u", PAGE, 1)], "page_id long, url string, html string, text int")
    assert [len(r["text"]) > 0 for r in html_extract.extract(rows).collect()] == [False, True]
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_densities_equal_the_formula():
    import math

    tree = html_extract.Tree("<body><div><p>Some text that is long <a href=x>with a link</a> in it.</p><p>More.</p></div><ul><li><a>one</a></li><li><a>two</a> 3</li></ul></body>")
    found, chars = html_extract.densities(tree)
    below = {i: [k for k in range(len(tree.tags)) if i < k < tree.end[i]] for i in range(len(tree.tags))}
    own, linked = Counter(), Counter()
    for i, text in tree.events:
        if text:
            own[i] += len(text.strip())
            linked[i] += len(text.strip()) if any(tree.tags[k] == "a" for k in range(1, i + 1) if k <= i < tree.end[k]) else 0
    count = {i: (sum(own[k] for k in [i, *below[i]]), len(below[i]), sum(linked[k] for k in [i, *below[i]]), sum(tree.tags[k] == "a" for k in below[i])) for i in below}
    body = count[tree.tags.index("body")]
    for i, (c, t, lc, lt) in count.items():
        t, lc1, lt = max(t, 1), max(lc, 1), max(lt, 1)
        want = c / t * math.log(max(c * t / (lc1 * lt), 1)) / math.log(math.log(c * lc1 / max(c - lc1, 1) + body[2] * c / body[0] + math.e)) if c else 0.0
        assert chars[i] == c and math.isclose(found[i], want, abs_tol=1e-12)


def test_pages_without_marks_of_their_own():
    """Without article or main, the densities alone find the text; long pages of stray tags are read in linear time."""
    text = "A paragraph of the article that goes on for a while, with words enough. " * 4
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><div><h1>Title</h1><p>{text}</p><p>{text}</p></div></div><div><a href=3>Imprint</a></div></body>"
    assert html_extract.main_text(page) == "\n".join(["Title", text.strip(), text.strip()])
    assert html_extract.main_text(page.replace("<h1>", "<article><h1>").replace("</p></div>", "</p></article></div>")) == "\n".join(["Title", text.strip(), text.strip()])
    assert html_extract.main_text("<b>x" * 300_000 + "</i>" * 300_000).count("x") == 300_000
    assert len(html_extract.main_text("<div><li>y" * 100_000 + "</p></ul>" * 100_000)) == 199_999


# 6


def test_bpe_equals_the_library(spark, odd, none, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    for frame, rows in ((odd, ODD), (spark.read.parquet(f"{sf}/documents.parquet"), texts(spark, sf).items())):
        want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
        found = bpe.encode_decode(frame).collect()
        assert sorted(tuple(r["ids"]) for r in found) == want
        assert all(r["decoded"] == tok.decode(r["ids"], skip_special_tokens=False) for r in found)
    assert bpe.encode_decode(none).count() == 0


# 7


def jaccard(a, b):
    a, b = Counter(WORD.findall(a.lower())), Counter(WORD.findall(b.lower()))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark, sf):
    rows = sorted(texts(spark, sf).items())
    found = {r["doc_id"]: r for r in QUERIES["op7_fingerprint"](spark, sf).collect()}
    errors = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and found[i]["n_chars"] == len(t)
        errors += [found[i]["near_edited"] - jaccard(t, edited), found[i]["near_next"] - jaccard(t, after)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(found[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_signatures_equal_a_scalar_sampler(spark):
    import math
    import struct

    import xxhash

    q = fingerprint.gamma_quantiles(1 << fingerprint.QUANTILE_BITS)
    assert np.allclose(1 - (1 + q) * np.exp(-q), (np.arange(len(q)) + 0.5) / len(q))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(1, "one two two three three three"), (2, "Two two TWO"), (3, "word " * 1000 + "rare"), (4, "\u00e9t\u00e9 2024 a-b")]
    want = {}
    for i, text in rows:
        best = [None] * fingerprint.SAMPLES
        for word, count in Counter(WORD.findall(text.lower())).items():
            term = xxhash.xxh64_intdigest(word.encode(), 42)
            for k in range(fingerprint.SAMPLES):
                z = xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<Q", term), 42))
                r, c = q[z & 4095], q[(z >> 12) & 4095]
                beta = ((z >> 24) & ((1 << 20) - 1)) / (1 << 20)
                t = math.floor(math.log(count) / r + beta)
                key = signed(((int((math.log(c) - r * (t - beta + 1)) * (1 << 20)) << 28) + (z >> 36)) & ((1 << 64) - 1))
                best[k] = key if best[k] is None else min(best[k], key)
        want[i] = best
    docs = spark.createDataFrame(rows, "doc_id long, _text string")
    found = {r["doc_id"]: list(r["_sig"]) for r in fingerprint.signatures(docs, ["doc_id"]).collect()}
    assert np.mean([found[i][k] == want[i][k] for i in want for k in range(fingerprint.SAMPLES)]) > 0.99


def test_every_bucket_is_a_partition_of_its_own(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(None, "x")], "doc_id long, text string")
    rows = fingerprint.edited_pairs(docs)
    per = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("_bucket").alias("n")).collect()
    assert {r["n"] for r in per} == {1} and len(per) == 4
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()  # the windows use the partitions as they are
    one = fingerprint.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).where("not _ghost").collect()
    assert [r["_edited"] for r in one] == ["abcabc"]


def test_fingerprints_of_odd_rows(odd, none):
    sig = {(r["doc_id"], r["k"]): r["s"] for r in fingerprint.signatures(odd.withColumn("k", F.monotonically_increasing_id()).withColumn("_text", F.coalesce("text", F.lit(""))), ["doc_id", "k"]).select("doc_id", "k", fingerprint.shown(F.col("_sig")).alias("s")).collect()}
    by = {}
    for (i, _), s in sig.items():
        by.setdefault(i, []).append(s)
    assert len(sig) == len(ODD) and by[4][0] == by[4][1] and by[1] == by[2] and len({by[i][0] for i in (2, 3, 5, 7)}) == 4
    pairs = fingerprint.edited_pairs(odd).where("not _ghost").collect()
    assert len(pairs) == len(ODD) and fingerprint.edited_pairs(none).count() == 0


# 8


def test_token_store(spark, odd, none, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for frame, rows in ((spark.read.parquet(f"{sf}/documents.parquet"), sorted(texts(spark, sf).items())), (odd, sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)))):
        path = work_path(spark, "test-store")
        token_store.write(frame, path)
        at, want = 0, []
        for i, t in rows:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert set(map(tuple, token_store.checked(spark, path).collect())) == set(want)
        whole = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in token_store.documents(spark, path).collect()}
        assert {k: zlib.crc32(v) for k, v in whole.items()} == {(i, s): c for i, s, _, c in want}
        chunks = spark.read.parquet(f"{path}/chunks")
        assert chunks.count() == chunks.select("digest").distinct().count()
        stored = spark.read.parquet(f"{path}/manifests")
        assert stored.where("level = 1 and node = 0 and bucket >= 0").count() == spark.read.parquet(f"{path}/recipes").select("bucket").distinct().count()
        assert stored.where("bucket = -1").count() == 1  # one root of all
    path = work_path(spark, "test-store")
    token_store.write(none, path)
    assert token_store.checked(spark, path).count() == 0


def test_changed_chunks_are_found(spark):
    path = work_path(spark, "test-store")
    token_store.write(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), path)
    bad = spark.read.parquet(f"{path}/chunks").withColumn("data", F.lit(b"\x01\x00\x02\x00\x03\x00\x02\x00")).collect()
    spark.createDataFrame(bad, "digest binary, n int, data binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="isn't what its name says"):
        token_store.checked(spark, path).collect()


def test_changed_recipes_are_found(spark):
    path = work_path(spark, "test-store")
    token_store.write(spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string"), path)
    recipes = spark.read.parquet(f"{path}/recipes")
    rows, kind = recipes.collect(), recipes.schema
    assert token_store.checked(spark, path).count() == 40
    other = {**rows[5].asDict(), "root": rows[6]["root"], "digests": rows[6]["digests"]}
    for bad in (rows[1:], rows[:-1], [*rows, rows[3]], [*rows[:5], tuple(other[c] for c in kind.names), *rows[6:]]):
        spark.createDataFrame(bad, kind).write.mode("overwrite").parquet(f"{path}/recipes")
        for read in (token_store.checked, token_store.documents):
            with pytest.raises(ValueError, match="don't give its manifest"):
                read(spark, path)


def test_chunks_are_cut_by_content():
    random = np.random.default_rng(3)
    a = random.integers(0, 50_000, 5000).astype(np.uint32)
    with np.errstate(over="ignore"):
        one, two = (token_store.cut(x) for x in (a, np.concatenate([a[:100], a[:1] + 1, a[100:]])))
    assert one[-1] == 5000 and all(0 < y - x <= token_store.MOST for x, y in zip([0, *one], one, strict=False))
    assert len({5000 - x for x in one} & {5001 - x for x in two}) > len(one) / 2


# 9


def test_archives(spark, sf):
    big = "é" * 400_000
    rows = [(1, "u", big), (2, "u", big), (3, "v\r\nx", None), (4, None, ""), (5, "w", "a\r\n\r\nb"), (None, "w", "zz"), (7, "w", "zz"), (7, "w", "zz")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    chunks = warc.read(spark, warc.write(pages, work_path(spark, "test-warc"), chunk=100_000), chunk=70_000).collect()
    last = {(r["page"], r["record_type"], r["refers"], r["bytes"]) for r in chunks if r["last"]}
    assert last == {("1", "response", None, 800_000), ("2", "revisit", "1", 0), ("3", "response", None, 0), ("4", "revisit", "3", 0), ("5", "response", None, 6), (None, "revisit", "7", 0), ("7", "response", None, 2)}
    own = sorted((r for r in chunks if r["page"] == "1"), key=lambda r: r["chunk_no"])
    assert b"".join(r["data"] for r in own).decode() == big and max(len(r["data"]) for r in own) == 70_000
    assert warc.write(pages.limit(0), work_path(spark, "test-warc")) == [] and warc.read(spark, []).count() == 0
    least = warc.read(spark, warc.write(pages, work_path(spark, "test-warc"), min_bytes=6), data=False).collect()
    assert {(r["page"], r["record_type"], r["refers"], r["payload_bytes"]) for r in least} == {("1", "response", None, 800_000), ("2", "revisit", "1", 800_000), ("3", "response", None, 0), ("4", "response", None, 0), ("5", "response", None, 6), (None, "response", None, 2), ("7", "response", None, 2)}
    rows = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    want = {(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first[raw] == i else "revisit", None if first[raw] == i else first[raw]) for i, raw in rows.items()}
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in QUERIES["op9_warc"](spark, sf).collect()} == want


# 10


def test_near_duplicates_hold_all_similar_pairs(spark, sf):
    rows = texts(spark, sf)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows.items() for w in [WORD.findall(t.lower())]}
    found = {r["doc_id"]: r["class_id"] for r in QUERIES["op10_near_dup"](spark, sf).collect()}
    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            j = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
            if j >= 0.8:
                assert found[a] == found[b]
    assert all(found[c] == c <= i for i, c in found.items())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_alignment_equals_edit_distance():
    random = np.random.default_rng(5)
    pairs = []
    for _ in range(150):
        a = random.integers(0, 30, random.integers(1, 60))
        b = [x for x in a.tolist() if random.random() > 0.08]
        for _ in range(random.integers(0, 8)):
            b.insert(random.integers(0, len(b) + 1), int(random.integers(0, 30)))
        pairs.append((a, np.array(b, np.int64)))
    want = [edits(a.tolist(), b.tolist()) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    assert near_dup.alike(pairs).tolist() == want and 20 < sum(want) < 140


def test_groups_of_copies(spark, odd, none):
    random = np.random.default_rng(1)
    base = [f"w{x}" for x in random.integers(0, 5000, 120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for p in random.integers(0, 120, 3):
            w[p] = f"x{random.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100, " ".join(f"y{x}" for x in random.integers(0, 5000, 120))), (101, " ".join(base).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    assert {found[i] for i in [*range(60), 101]} == {0} and found[100] == 100
    assert sorted(r["doc_id"] for r in near_dup.drop_near_duplicates(docs).collect()) == [0, 100]
    kept = near_dup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "None", "5", "6", "7", "8"])
    assert near_dup.drop_near_duplicates(none).count() == 0


def test_ids_with_several_texts(spark):
    random = np.random.default_rng(2)
    a, c = ([f"{x}{i}" for i in random.integers(0, 9000, 100)] for x in "ac")
    rows = [(1, " ".join(a)), (1, " ".join(c)), (8, " ".join(["new", *a[1:]])), (9, " ".join([*c[:-1], "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["key"]): r["class_id"] for r in near_dup.classes(docs).collect()}
    assert sorted(found.values()) == [8, 8, 9, 9] and {i: x for (i, _), x in found.items() if i != 1} == {8: 8, 9: 9}
    assert sorted(r["doc_id"] for r in near_dup.drop_near_duplicates(docs).collect()) == [8, 9]
    text = spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string")
    assert {r["class_id"] for r in near_dup.classes(text).collect()} == {"8", "9"}


def test_repeated_rows_are_aligned_once(spark, monkeypatch):
    a = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(a)), (2, " ".join(["x", *a[1:]]))] * 1000
    made = []
    real = near_dup.saved
    monkeypatch.setattr(near_dup, "saved", lambda df, name, shrink=1: made.append((name, real(df, name, shrink))) or made[-1][1])
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, _best int").repartition(8)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [(r["doc_id"], r["_best"]) for r in kept.collect()] == [(1, 3)]
    assert [df.count() for name, df in made if name == "aligned"] == [1]


def alignable(rows):
    """Classes by aligning all pairs of texts that share a sample: brute force of the first sketch."""
    names = sorted(rows)
    h = {i: np.array([zlib.crc32(x.encode()) for x in rows[i]], np.int64) for i in names}
    pairs = [(a, b) for k, a in enumerate(names) for b in names[:k]]
    good = near_dup.alike([(h[a], h[b]) for a, b in pairs])
    return {p for p, g in zip(pairs, good, strict=True) if g}


def closed(links, names):
    root = {i: i for i in names}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in names}


def test_crowded_buckets_lose_no_link(spark):
    """A chain of texts, each a little further from the first: most align with neither hub, but all with their neighbours; and unlike texts around one passage."""
    random = np.random.default_rng(4)
    base = [f"w{x}" for x in random.integers(0, 5000, 200)]
    rows, now = {}, list(base)
    for i in range(150):
        for p in random.integers(0, 50, 2):  # the chain leaves the last 150 words alone
            now[p] = f"c{random.integers(0, 10**6)}"
        rows[i] = list(now) + [f"t{i}"]
    passage = [f"p{x}" for x in random.integers(0, 5000, 150)]
    for i in range(150, 400):
        rows[i] = passage + [f"u{x}" for x in random.integers(0, 10**6, 60)]
    for i in range(400, 440):  # each is a copy of one of those
        rows[i] = ["copy", *rows[i - 200][1:]]
    found = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()}
    assert found == closed(alignable(rows), rows)


def test_one_sample_shared_by_many(spark):
    """Ten thousand texts that share a sample and align with none."""
    random = np.random.default_rng(6)
    rows = [(i, "s1 s2 s3 s4 s5 s6 s7 s8 " + " ".join(f"n{x}" for x in random.integers(0, 10**6, 12))) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert near_dup.classes(docs).where("class_id <> doc_id").count() == 0


def test_recall_of_edited_texts(spark):
    """Texts with scattered edits, by shingle similarity: what the docstring says of 0.8 and of 0.6, and no class but of aligned pairs."""
    random = np.random.default_rng(8)
    rows, pairs = {}, []
    for i in range(300):
        a = [f"w{x}" for x in random.integers(0, 20_000, 150)]
        b = list(a)
        for p in random.choice(150, random.integers(1, 15), replace=False):
            b[p] = f"e{random.integers(0, 10**6)}"
        rows[2 * i], rows[2 * i + 1] = a, b
        s, t = ({tuple(w[k : k + 5]) for k in range(146)} for w in (a, b))
        pairs.append((2 * i, 2 * i + 1, len(s & t) / len(s | t)))
    found = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()}
    met = lambda low, high: [found[a] == found[b] for a, b, j in pairs if low <= j < high]
    assert all(met(0.8, 1)) and np.mean(met(0.6, 0.8)) > 0.95 and len(met(0.8, 1)) > 20 and len(met(0.6, 0.8)) > 50
    assert all(found[i] in (i, i - 1) for i in rows)


def test_components(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8), (8, 7), (5, 5), (20, 4)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {2: 1, 3: 1, 4: 1, 20: 1, 9: 7, 8: 7}
    assert components.components(edges.limit(0)).count() == 0
    star = spark.createDataFrame([(i, 0) for i in range(1, 500)] + [(i + 1, i) for i in range(1000, 1200)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(star).collect()} == {i: 0 for i in range(1, 500)} | {i: 1000 for i in range(1001, 1201)}


# all


def test_pipeline(spark, sf):
    """Each stage on its own input: what it keeps and makes against plain Python."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, tok = docs.columns, Tokenizer.from_file(bpe.default_path())
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    grams = grams_of(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        path = work_path(spark, "test-stage")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        kept = {r["doc_id"]: r for r in rows}
        assert len(kept) == len(rows) and set(kept) <= set(before) and (docs.columns == names or name == "encoding")
        text = {i: r["text"] or "" for i, r in before.items()}
        if name == "quality_classifier":
            score = dict(zip(text, model.scores(list(text.values())), strict=True))
            assert set(kept) == {i for i in text if score[i] >= 0.5}
        elif name == "near_duplicates":
            links = alignable({i: words(t) for i, t in text.items()})
            whole = closed(links, text)
            own = near_dup.classes(spark.createDataFrame([(i, t) for i, t in text.items()], "doc_id long, text string")).collect()
            assert set(kept) == {r["class_id"] for r in own} and all(whole[r["doc_id"]] == whole[r["class_id"]] for r in own)
        elif name == "decontamination":
            assert set(kept) == {i for i, t in text.items() if not hit_words(t, grams)[1]}
        elif name == "personal_data":
            assert set(kept) == set(before) and not any(base_spans(r["text"]) for r in rows) and all(len(r["text"] or "") == r["n_chars"] for r in rows if r["text"] != text[r["doc_id"]])
        else:
            assert all(r["ids"] == tok.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["decoded"] == tok.decode(r["ids"], skip_special_tokens=False) for r in rows)
    assert docs.columns == ["doc_id", "ids", "decoded"] and len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_tables_go(spark):
    from ledgerlens.llm import common

    with common.scratch(spark):
        path = common.saved(spark.range(3), "scratch").inputFiles()[0]
        assert spark.read.parquet(path).count() >= 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_sql_where_there_is_any(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        frame = QUERIES[name](spark, sf)
        found = con.sql(sql)
        order = [found.columns.index(c) for c in frame.columns]
        assert sorted(map(tuple, frame.collect())) == sorted(tuple(r[i] for i in order) for r in found.fetchall())
