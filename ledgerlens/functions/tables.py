"""Python table functions for SQL: statement text to transactions and documents to chunks, row by row, for LATERAL joins.

``parse_statement`` reads lines with Python's own patterns, white space, digits and dates, apart from the column expressions of
``operators.transactions.parse``, against which it is tested; ``chunk_document`` shares the packing of ``operators.retrieval``.
Null texts give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ledgerlens.operators import retrieval
from ledgerlens.operators import transactions as tx

# The formats of dates in the order in which they are tried.
FORMATS = ["%d %b %Y", "%d %B %Y", "%b %d %Y", "%B %d %Y", "%d/%m/%Y", "%d/%m/%y", "%d-%m-%Y", "%d-%m-%y", "%Y/%m/%d", "%Y-%m-%d"]
DATE, AMOUNT, CURRENCY = re.compile(tx.DATE), re.compile(tx.AMOUNT), re.compile(r"₹|Rs\.?|INR|\$", re.IGNORECASE)
TOKEN, BALANCE = re.compile(r"[A-Za-z0-9_&./-]+"), re.compile(r"\d+[\d,.]+\s*$")
MARKER, NOISE = re.compile("|".join(tx.MARKERS)), frozenset(tx.NOISE_WORDS)
DEBIT, CREDIT = (re.compile(f" (?:{'|'.join(words)}) ") for words in (tx.DEBIT_WORDS, tx.CREDIT_WORDS))
#: How many written dates a worker remembers: lines share their days, and each format that doesn't fit costs an exception.
REMEMBERED = 1 << 16
HEADING = re.compile(r"(#{1,3}|[A-Z][A-Z\s]+:|\d+\.)")


@lru_cache(REMEMBERED)
def day(raw: str) -> str | None:
    """A written date as yyyy-mm-dd."""
    for f in FORMATS:
        try:
            return datetime.strptime(raw.strip().replace(",", ""), f).date().isoformat()  # years of four digits
        except ValueError:
            pass
    return None


def named(piece: str) -> str:
    """What is left of a piece of a line without noise words and numbers."""
    return " ".join(w for w in TOKEN.findall(piece.strip(tx.EDGE)) if w.lower() not in NOISE and not w.isdigit())


def amount_of(line: str, begin: int) -> tuple[float, re.Match] | None:
    """The amount from ``begin`` on: with a currency or suffix first, then the smallest, then the first; long whole numbers are references."""
    best = None
    for m in AMOUNT.finditer(line):
        digits = m[1].replace(",", "")
        if m.start() < begin or ("." not in digits and len(digits) > tx.LONGEST_NUMBER):
            continue
        rank = (-2 * bool(CURRENCY.search(m[0])) - bool(m[2]), float(digits))
        if best is None or rank < best[0]:
            best = rank, m
    return best and (best[0][1], best[1])


def kind(line: str, suffix: str | None) -> str:
    if suffix:
        return "debit" if suffix.lower() == "dr" else "credit"
    padded = f" {line.lower()} "
    return "credit" if not DEBIT.search(padded) and CREDIT.search(padded) else "debit"


def transaction(line: str) -> tuple[str, float, str, str] | None:
    """(date, amount, type, merchant) of a line, if it holds a transaction."""
    date = DATE.search(line)
    if date is None or MARKER.search(line.lower()):
        return None
    when = day(date[0])
    found = when and amount_of(line, date.end())
    if not found:
        return None
    amount, m = found
    after = line[m.end() :].strip(tx.EDGE)
    merchant = ("" if BALANCE.match(after) else named(after)) or named(line[date.end() : m.start()])
    return when, amount, kind(line, m[2]), merchant or "UNKNOWN"


@udtf(returnType="seq bigint, date string, amount double, type string, merchant string")
class ParseStatement:
    def eval(self, text: str) -> Iterator[tuple]:
        for seq, raw in enumerate((text or "").splitlines()):
            found = transaction(" ".join(raw.split()))
            if found:
                yield seq, *found


@udtf(returnType="chunk_id string, position int, page_number int, page_by_offset int, section_title string, content string, word_count int, char_count int")
class ChunkDocument:
    def eval(self, document_id: str, text: str, size: int, overlap: int) -> Iterator[tuple]:
        text, before = text or "", ""
        for i, (chunk, at) in enumerate(retrieval.pieced(text, size * retrieval.CHARS_PER_TOKEN)):
            content = chunk if i == 0 else retrieval.tail(before, overlap * retrieval.CHARS_PER_TOKEN, "last_word") + "\n\n" + chunk
            found, before = text.find(content), chunk
            title = next((x.strip() for x in content.split("\n")[:3] if HEADING.match(x.strip())), None)
            yield f"{document_id}_chunk_{i:04d}", i, None if found < 0 else found // retrieval.PAGE_CHARS + 1, at // retrieval.PAGE_CHARS + 1, title, content, len(content.split()), len(content)


def register(spark: SparkSession) -> None:
    """parse_statement(text) and chunk_document(document_id, text, size, overlap) as table functions of the session's SQL."""
    spark.udtf.register("parse_statement", ParseStatement)
    spark.udtf.register("chunk_document", ChunkDocument)
