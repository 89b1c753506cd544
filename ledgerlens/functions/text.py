"""Text functions: cleaning, counts, patterns and masks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns that the counts are defined by.
PATTERNS = {
    "currency_count": r"(?i)(?:(?:₹|\$|€|£)\s?\d[\d,]*(?:\.\d{1,2})?|\d[\d,]*(?:\.\d{1,2})?\s?(?:INR|USD|EUR|GBP|Rs\.?))",
    "percentage_count": r"(?i)\d+\.?\d*\s?%|percent",
    "crores": r"(?i)\d+\.?\d*\s?(?:crore|cr\.?)",
    "lakhs": r"(?i)\d+\.?\d*\s?(?:lakh|lac)",
    "millions": r"(?i)\d+\.?\d*\s?(?:million|M)",
    "billions": r"(?i)\d+\.?\d*\s?(?:billion|B)",
    "date_count": r"(?i)\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b",
    "pan_count": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "gstin_count": r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z\d]\b",
    "account_count": r"\b\d{9,18}\b",
    "email_count": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone_count": r"(?:\+\d{1,3}-?)?\(?\d{3}\)?-?\d{3}-?\d{4}",
}
WORD = r"[\p{L}\p{N}_]+"
PREVIEW_CHARS = 500
#: White space as Python's texts have it: that of Unicode and four separators. For use after (?U).
SPACE = r"[\s\x1c-\x1f]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII texts are returned as they are."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def tidy_lines(text: Column) -> Column:
    """Lines with single blanks, trimmed, without empty ones, joined by line ends."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    tidy = F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, r"[ \t\f\x0B]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def clean(text: Column) -> Column:
    return tidy_lines(nfkc(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; a run inside is looked at once."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def blank_words(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1


#: What a text must have for a pattern to be tried, where that isn't a digit.
NEEDS = {"email_count": "@", "percentage_count": "(?i)%|percent"}


def pattern_count(text: Column, name: str) -> Column:
    """How often a pattern occurs; texts that lack what every match has aren't searched."""
    return F.when(text.rlike(NEEDS.get(name, "[0-9]")), F.regexp_count(text, F.lit(PATTERNS[name]))).otherwise(0)


def mask_sensitive(text: Column) -> Column:
    """PANs keep their digits, account numbers their last four."""
    pans = F.regexp_replace(text, r"\b[A-Z]{5}(\d{4})[A-Z]\b", "XXXXX$1X")
    pieces, found = F.split(pans, PATTERNS["account_count"], -1), F.regexp_extract_all(pans, F.lit(PATTERNS["account_count"]), F.lit(0))
    starred = F.transform(found, lambda a: F.concat(F.repeat(F.lit("*"), F.length(a) - 4), F.right(a, F.lit(4))))
    return F.array_join(F.zip_with(pieces, starred, lambda p, a: F.concat(p, F.coalesce(a, F.lit("")))), "")


def section_title(text: Column) -> Column:
    """The first of the first three lines, without white space around, that looks like a heading: it begins with #, capitals and a colon, or a number and a dot."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 3), stripped)
    return F.get(F.filter(lines, lambda x: x.rlike(rf"(?U)^(#{{1,3}}|[A-Z](?:[A-Z]|{SPACE})+:|\d+\.)")), F.lit(0))


def safe_name(name: Column) -> Column:
    return F.left(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", ""), F.lit(30))


def preview(text: Column, size: int = PREVIEW_CHARS) -> Column:
    """The first characters of a text, as prompts and lists show it."""
    return F.left(text, F.lit(size))


def file_base_name(name: Column) -> Column:
    """A name without its ending, runs of what isn't a letter, digit, _ or - as _, at most 80 characters; a default for none."""
    default = "risk_analysis_report"
    base = F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit(default)), r"\.[^.]+$", "")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(base, "[^a-zA-Z0-9_-]+", "_"), F.lit(80)), F.lit("")), F.lit(default))


def format_bytes(size: Column) -> Column:
    """-- for none, B, then KB and MB with one decimal."""
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "--")
        .when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B")))
        .when(size < 1048576, F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", size / 1048576), F.lit(" MB")))
    )


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as a double: its product with a power of ten to whole numbers, halves away from 0. ``F.round`` goes by the digits that are shown: 19.955 is a little less than that, but becomes 19.96."""
    return F.round(value * 10.0**digits) / 10.0**digits


def format_money(value: Column) -> Column:
    return F.format_number(F.coalesce(value, F.lit(0.0)), 2)


def format_percent(share: Column) -> Column:
    return F.concat(F.format_string("%.2f", F.coalesce(share, F.lit(0.0)) * 100), F.lit("%"))


def format_amount(amount: Column) -> Column:
    """$150K from 100,000 on, $1,500 from 1,000 on, else $50.25."""
    return (
        F.when(amount >= 100000, F.concat(F.lit("$"), F.format_string("%.0f", amount / 1000), F.lit("K")))
        .when(amount >= 1000, F.concat(F.lit("$"), F.format_number(amount, 0)))
        .otherwise(F.concat(F.lit("$"), F.format_string("%.2f", amount)))
    )
