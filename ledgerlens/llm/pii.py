"""Personal data: patterns for base entities, then information-theoretic sanitisation of the terms that give them away.

Base entities (e-mail, IP address, card and phone number) are pattern matches with checks. Around each one lie context terms. For
an entity e and a term t the corpus gives n(e, t), the occurrences of t in contexts of e, and n(t), all its occurrences. The
information that t leaves about e is IC(e) - PMI(e; t) = log2(n(t) / n(e, t)) bits. Small counts are weak evidence: n(e, t) counts
different contexts only, and its share of n(t) is taken at the lower end of its confidence interval (Wilson's, ``Z`` deviations). A
term that so leaves at most ``BITS`` bits discloses e and becomes a span of kind "term" wherever it stands. Base spans always stay; a term within one is part of it.

All is Catalyst. A match's offset is the running sum of the lengths of the pieces and matches before it, taken in a window over
the matches of a document; texts aren't shuffled for base entities. Term counts are partial aggregates over exploded words, joined
to the candidate terms, which are counted before they are broadcast.

Edge cases: null texts are empty and have no spans; repeated rows get equal spans; null ids are kept; offsets are code points;
texts of any length are searched whole, with patterns that don't back-track; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import covered, keyed, same_row, saved, small, table, text_of, uncovered

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"

#: The patterns of the contract. Possessive loops and look-behinds only spare restarts that cannot match; \G lets a match start where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{M}]{3,}+"

#: Characters to each side of an entity whose whole words are its context.
CONTEXT_CHARS = 80
BITS = 1.0
#: Deviations of the lower bound: 95 of 100 from one side.
Z = 1.645


def share_low(hits: Column, trials: Column, z: float = Z) -> Column:
    """The lower end of Wilson's confidence interval of a share."""
    p = hits / trials
    return (p + z * z / (2 * trials) - z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum: from the right, every second digit counts double, less 9 above 9."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    octet = "0*+(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == 1, match.rlike(rf"^(?:(?:{octet})\.){{3}}(?:{octet})$".replace("0*+", "0*")))
        .when(kind == 2, F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(False))
        .when(kind == 3, (n >= 9) & (n <= 15))
        .otherwise(True)
    )


def before(piece: Column) -> Column:
    """The whole words in the last characters of a piece of text."""
    return F.when(F.length(piece) > CONTEXT_CHARS, F.regexp_replace(F.right(piece, F.lit(CONTEXT_CHARS + 1)), r"^[\p{L}\p{M}]*+", "")).otherwise(piece)


def after(piece: Column) -> Column:
    """The whole words in the first characters of a piece of text."""
    return F.when(F.length(piece) > CONTEXT_CHARS, F.regexp_replace(F.left(piece, F.lit(CONTEXT_CHARS + 1)), r"(?<![\p{L}\p{M}])[\p{L}\p{M}]*+$", "")).otherwise(piece)


def matches(texts: DataFrame, patterns: dict[int, str], needs: dict[int, str]) -> DataFrame:
    """``texts`` (doc_id, _th, _text) exploded to matches: doc_id, _th, _row, kind, i (number), before (length of the piece before it), match, around.

    _row tells repeated rows apart. Matches and the pieces between them are columns of their own, so that each is found once.
    """
    numbered = texts.withColumn("_row", F.monotonically_increasing_id())  # before the explode, so that it tells documents apart
    nothing = F.array().cast("array<string>")
    for k, pattern in patterns.items():
        tried = F.col("_text").rlike(needs[k])
        numbered = numbered.withColumn(f"_f{k}", F.when(tried, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(nothing))
    for k, pattern in patterns.items():
        numbered = numbered.withColumn(f"_p{k}", F.when(F.size(f"_f{k}") > 0, F.split("_text", pattern, -1)).otherwise(nothing))

    def placed(k: int) -> Column:
        rows = F.arrays_zip(F.col(f"_f{k}").alias("m"), F.col(f"_p{k}").alias("p"), F.slice(f"_p{k}", 2, F.greatest(F.lit(0), F.size(f"_p{k}"))).alias("n"))
        return F.transform(rows, lambda z, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(z["p"]).alias("before"), z["m"].alias("match"), F.concat(before(z["p"]), F.lit(" "), after(z["n"])).alias("around")))

    found = numbered.select("doc_id", "_th", "_row", F.explode(F.concat(*map(placed, patterns))).alias("_m"))
    return found.select("doc_id", "_th", "_row", "_m.*").where(F.col("match").isNotNull())


def offsets(found: DataFrame, *keys: str) -> DataFrame:
    """``found`` (keys, _row, kind, i, before, match) with _start and _end, code points, end exclusive."""
    order = Window.partitionBy(*keys, "_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.length("match")).over(order)
    return found.withColumn("_end", end.cast("int")).withColumn("_start", F.col("_end") - F.length("match"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, _row, kind, _start, _end, match, around) of all base entities; kind counts KINDS, _row tells repeated rows apart."""
    texts = keyed(docs, "doc_id").where(F.col("_text").rlike(r"@|\+[0-9]|[0-9][\x20.-]?[0-9]"))
    found = matches(texts, {i: PATTERNS[k] for i, k in enumerate(KINDS)}, {i: NEEDS[k] for i, k in enumerate(KINDS)})
    placed = offsets(found, "doc_id", "_th").where(valid(F.col("kind"), F.col("match")))
    return placed.select("doc_id", "_th", "_row", "kind", "_start", "_end", "match", "around")


def disclosing_terms(docs: DataFrame, spans: DataFrame, bits: float = BITS, z: float = Z) -> DataFrame | None:
    """(entity, term, contexts, total) of the terms that leave at most ``bits`` bits about an entity; None if there are no candidates at all."""
    around = spans.select("doc_id", "_th", F.col("match").alias("entity"), F.lower("around").alias("_around")).withColumn("_context", F.xxhash64("_around"))
    # even if it stood nowhere else a term must be seen in so many contexts for the lower bound to be high enough
    least = z * z / (2**bits - 1)
    often = around.groupBy("entity").agg(F.approx_count_distinct("_context", 0.05).alias("n")).where(F.col("n") >= 0.8 * least).select("entity")
    word = F.explode(F.regexp_extract_all("_around", F.lit(WORD), F.lit(0))).alias("term")
    pairs = around.join(often, "entity").select("entity", "_context", word)
    seen = pairs.groupBy("entity", "term", "_context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("contexts"))
    # a term near entities in d documents occurs d times at least: common words go before all words are counted
    spread = around.select("doc_id", "_th", word).distinct().groupBy("term").agg(F.count("*").alias("least"))
    trials = lambda total: F.col("contexts") + F.greatest(F.lit(0), F.col(total) - F.col("together"))  # noqa: E731  what stands apart, and contexts
    left = lambda total: -F.log2(share_low(F.col("contexts"), trials(total), z))
    seen = seen.where(F.col("contexts") >= least).join(spread, "term").where(left("least") <= bits)
    seen = saved(seen.select("entity", "term", "together", "contexts"), "disclosure", shrink=8)
    candidates = seen.select("term").distinct()
    rows = candidates.count()
    if not rows:
        return None
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))).alias("term"))
    total = words.join(small(candidates, rows), "term", "left_semi").groupBy("term").agg(F.count("*").alias("total"))
    return saved(seen.join(total, "term").where(left("total") <= bits).select("entity", "term", "contexts", "total"), "terms", shrink=8)


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, _th, kind, _start, _end) of all occurrences of ``terms``. Only documents that have one are taken apart."""
    rows = terms.count()
    texts = keyed(docs, "doc_id")
    words = texts.select("doc_id", "_th", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)))).alias("term"))
    having = words.join(small(terms, rows), "term", "left_semi").select("doc_id", "_th").distinct()
    texts = texts.join(having, same_row(texts, having, "doc_id", "_th"), "left_semi")
    found = matches(texts, {len(KINDS): WORD}, {len(KINDS): WORD})
    placed = offsets(found, "doc_id", "_th").withColumn("term", F.lower("match")).join(small(terms, rows), "term", "left_semi")
    return placed.select("doc_id", "_th", "kind", "_start", "_end").distinct()


def spans(docs: DataFrame, bits: float = BITS, z: float = Z) -> DataFrame:
    """(doc_id, _th, kind, _start, _end) of base entities and of disclosing terms outside them."""
    base = saved(base_spans(docs), "base", shrink=8)
    found = disclosing_terms(docs, base, bits, z)
    terms = None if found is None else found.select("term").distinct()
    base = base.select("doc_id", "_th", "kind", "_start", "_end").distinct()
    if terms is None or terms.isEmpty():
        return base
    both = base.unionByName(term_spans(docs, terms))
    order = Window.partitionBy("doc_id", "_th").orderBy("_start", "kind")
    is_base = F.col("kind") < len(KINDS)
    before = F.max(F.when(is_base, F.col("_end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("_start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_before", before).withColumn("_after", after)
    free = (F.col("_start") >= F.coalesce("_before", F.lit(0))) & ((F.col("_end") <= F.col("_after")) | F.col("_after").isNull())
    return both.where(is_base | free).drop("_before", "_after")


def per_document(found: DataFrame) -> DataFrame:
    """(doc_id, _th, _spans): the sorted structs (start, kind, end) of each document that has any."""
    return found.groupBy("doc_id", "_th").agg(F.sort_array(F.collect_list(F.struct(F.col("_start").alias("start"), "kind", F.col("_end").alias("end")))).alias("_spans"))


def sanitise(docs: DataFrame, bits: float = BITS, z: float = Z) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first. n_chars, if there, follows."""
    rows, names = covered(docs)
    order = Window.partitionBy("doc_id", "_th").orderBy("_start", "kind")
    found = spans(docs, bits, z).withColumn("_edge", F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("_group", F.sum(F.when(F.col("_start") < F.col("_edge"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("doc_id", "_th", "_group").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.min_by("kind", F.struct("_start", "kind")).alias("kind"))
    per = per_document(found).select(F.col("doc_id").alias("_id"), F.col("_th").alias("_own"), "_spans")
    text = F.col(names["text"])
    joined = rows.join(per.hint("merge"), F.col(names["doc_id"]).eqNullSafe(F.col("_id")) & (F.xxhash64(text_of(names["text"])) == F.col("_own")), "left")
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, TERM]])
    parts = F.transform(
        F.sequence(F.lit(0), F.size("_spans")),
        lambda i: F.concat(
            F.when(i > 0, F.get(label, F.get("_spans", i - 1)["kind"])).otherwise(""),
            F.substring(text, F.coalesce(F.get("_spans", i - 1)["end"], F.lit(0)) + 1, F.coalesce(F.get("_spans", i)["start"], F.length(text)) - F.coalesce(F.get("_spans", i - 1)["end"], F.lit(0))),
        ),
    )
    clean = F.when(F.col("_spans").isNull(), text).otherwise(F.array_join(parts, ""))
    size = {"n_chars": F.when(F.col("_spans").isNull(), F.col(names["n_chars"])).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))} if "n_chars" in names else {}
    return uncovered(joined, names, text=clean, **size)


def shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, TERM]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    docs = table(spark, sf_dir, "documents")
    per = per_document(spans(docs))
    base = keyed(docs, "doc_id").select("doc_id", "_th")
    all_spans = F.coalesce(per["_spans"], F.array().cast(per.schema["_spans"].dataType))
    rows = base.join(per, same_row(base, per, "doc_id", "_th"), "left").select(base["doc_id"], all_spans.alias("_spans"))
    count = lambda i: F.size(F.filter("_spans", lambda s: s["kind"] == i)).cast("long")
    return rows.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(shown(F.filter("_spans", lambda s: s["kind"] < len(KINDS))), 256).alias("base_sha256"),
        shown(F.col("_spans")).alias("spans"),
    )
