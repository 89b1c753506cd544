"""Transactions from statement text: lines, filters and field extraction as one projection, without a shuffle or Python."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import normalised_date

# Patterns and word lists that the fields are defined by.
DATE = r"(?i)(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{2,4})"
AMOUNT = r"(?:(?:₹|Rs\.?|INR|\$)\s*)?(\d[\d,]*(?:\.\d{1,2})?)\s*(CR|DR|Cr|Dr)?"
DEBIT_WORDS = ["debit", "dr", "withdrawal", "purchase", "pos", "atm", "upi", "charges", "fee"]
CREDIT_WORDS = ["credit", "cr", "deposit", "salary", "refund", "reversal", "interest", "cashback"]
NOISE_WORDS = ["txn", "txnid", "narration", "ref", "utr", "imps", "neft", "rtgs", "upi", "pos", "debit", "credit", "dr", "cr", "payment", "transfer", "via", "to", "by"]
MARKERS = ["opening balance", "closing balance", "available balance", "statement period", "balance"]
EDGE = " -:|,./"
LONGEST_NUMBER = 8
#: Decimal digits of other scripts, which dates and amounts may be written in.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")


#: White space that doesn't end a line: of ASCII, and beyond, where what is ASCII is passed over by one cheap test.
BLANKS = r"[\t \x1f]+"
RARE_BLANK = r"(?=[^\x00-\x7f])[\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
ENDS = r"[\x0B\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: An amount is tried where one can begin only.
AMOUNT_HERE = "(?=[0-9RI$₹])" + AMOUNT
#: What a number that began inside the date goes on with.
NUMBER_REST = r"^[\d,]*(?:\.\d{1,2})?\s*(?:CR|DR|Cr|Dr)?"
SIGN = "[A-Za-z0-9_&./-]"
#: A token that is neither a noise word nor a number.
TOKEN = rf"(?<!{SIGN})(?!(?i:{'|'.join(NOISE_WORDS)}|\d+)(?!{SIGN})){SIGN}+"


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def lines(statements: DataFrame, key: str = "statement_id", text: str = "text") -> DataFrame:
    """(key, seq, line): the non-empty lines with single blanks; seq is the line's place in the text."""
    ended = F.regexp_replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), ENDS, "\n")
    single = F.regexp_replace(F.when(ascii_only(F.col(text)), ended).otherwise(F.regexp_replace(ended, RARE_BLANK, " ")), BLANKS, " ")
    split = F.split(single, "\n")  # by one plain character: a pattern would be compiled for each row
    found = statements.select(key, F.posexplode(split).alias("seq", "raw"))
    return found.select(key, F.col("seq").cast("long").alias("seq"), F.btrim("raw").alias("line")).where("line <> ''")


def plain_digits(line: Column) -> Column:
    """The line with the digits of other scripts as 0 to 9, place by place."""
    other = ~ascii_only(line) & line.rlike(r"(?U)(?=[^\x00-\x7f])\d")
    return F.when(other, F.translate(line, DIGITS, "".join(str(unicodedata.digit(c)) for c in DIGITS))).otherwise(line)


def tokens(text: Column) -> Column:
    """The tokens of a piece of a line without noise words and numbers."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def has_word(padded: Column, words: list[str]) -> Column:
    return padded.rlike(" (?:" + "|".join(words) + ") ")


def some(value: Column) -> Column:
    """The value, which should be a mere column, without the row if it is null. A filter would be pushed below the columns that the value is made of and find each again."""
    return F.explode(F.when(value.isNotNull(), F.array(value)))


#: What rows are left after each step of ``parse``, as it tells an observer.
STEPS = ["lines", "unmarked", "dated", "readable", "amounts"]


def parse(statements: DataFrame, key: str = "statement_id", text: str = "text", observe: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(key, seq, date, amount, type, merchant) of all lines that hold a transaction.

    Of the amounts after the date the one with a currency sign or a CR/DR suffix wins, then the smaller, then the first; numbers of more
    than eight digits without decimals are references. Nulls and lines without date or amount give no row. ``observe`` gets the rows
    and the name of each of ``STEPS`` and gives the rows to go on with.
    """
    seen = observe or (lambda rows, _: rows)
    rows = seen(lines(statements, key, text), "lines").withColumn("low", F.lower("line"))
    marked = [m for m in MARKERS if not any(o != m and o in m for o in MARKERS)]
    for m in marked:
        rows = rows.where(~F.contains("low", F.lit(m)))
    rows = seen(rows, "unmarked").withColumn("plain", plain_digits(F.col("line")))
    # the rest of the line belongs to the match, so that there is one date at most
    rows = rows.select("*", F.explode(F.regexp_extract_all("plain", F.lit(f"({DATE})(?s:.*)"), F.lit(1))).alias("raw_date"))
    rows = seen(rows, "dated")
    # days and months count in digits 0 to 9 only, years in those of other scripts too
    rows = rows.withColumn("date_at", F.call_function("locate", "raw_date", "plain"))
    own = F.substring("line", F.col("date_at"), F.length("raw_date"))
    readable = (own == F.col("raw_date")) | own.rlike(r"^(?:\p{ASCII}*[^\p{Nd}])?\p{Nd}+$|^\p{Nd}{4}[/-]\p{ASCII}+$")
    rows = rows.withColumn("tidy_date", F.when(readable, F.replace("raw_date", F.lit(","), F.lit("")))).withColumn("found", normalised_date(F.col("tidy_date")))
    rows = seen(rows.select("*", some(F.col("found")).alias("date")), "readable")
    rows = rows.withColumn("date_end", F.col("date_at") - 1 + F.length("raw_date"))
    # amounts begin after the date: a number that began inside it goes first, so that the others are those of the whole line
    rows = rows.withColumn("rest", F.regexp_replace(F.substring("plain", F.col("date_end") + 1, F.length("plain")), NUMBER_REST, ""))
    rows = rows.withColumn("full", F.regexp_extract_all("rest", F.lit(AMOUNT_HERE), F.lit(0))).withColumn("number", F.regexp_extract_all("rest", F.lit(AMOUNT_HERE), F.lit(1)))

    def ranked(number: Column, i: Column) -> Column:
        """(score, amount, place) of a number that isn't a reference. What stands before a match's number is a currency, an r after it ends a suffix."""
        digits, whole = F.replace(number, F.lit(","), F.lit("")), F.get("full", i)
        score = F.when(F.left(whole, F.lit(1)).between("0", "9"), 0).otherwise(-2) - F.when(F.right(whole, F.lit(1)).isin("r", "R"), 1).otherwise(0)
        return F.when(F.contains(number, F.lit(".")) | (F.length(digits) <= LONGEST_NUMBER), F.struct(score.alias("score"), digits.try_cast("double").alias("amount"), i.alias("place")))

    rows = rows.withColumn("first", F.array_min(F.transform("number", ranked)))
    rows = seen(rows.select("*", some(F.col("first")).alias("best")), "amounts")
    # the first place of a match's text, after the match before it, is the match's; places are those of characters, which a pattern's aren't beyond the basic plane
    rows = rows.withColumn("whole", F.get("full", F.col("best.place")))
    end = F.aggregate(F.slice("full", 1, F.col("best.place") + 1), F.lit(0), lambda at, x: F.call_function("locate", x, F.col("rest"), at + 1) - 1 + F.length(x))
    rows = rows.withColumn("end", F.length("plain") - F.length("rest") + end).withColumn("suffix", F.lower(F.right("whole", F.lit(2))))
    padded = F.concat(F.lit(" "), F.col("low"), F.lit(" "))
    kind = F.when(F.col("suffix") == "dr", "debit").when(F.col("suffix") == "cr", "credit").when(has_word(padded, DEBIT_WORDS), "debit").when(has_word(padded, CREDIT_WORDS), "credit").otherwise("debit")
    rows = rows.withColumn("after", F.btrim(F.substring("line", F.col("end") + 1, F.length("line")), F.lit(EDGE)))
    rows = rows.withColumn("words", F.when(~plain_digits(F.col("after")).rlike(r"^\d+[\d,.]+\s*$"), tokens(F.col("after"))))
    between = F.btrim(F.substring("line", F.col("date_end") + 1, F.col("end") - F.length("whole") - F.col("date_end")), F.lit(EDGE))
    rows = rows.withColumn("words", F.when(F.size("words") > 0, F.col("words")).otherwise(tokens(between)))
    merchant = F.when(F.size("words") > 0, F.array_join("words", " ")).otherwise("UNKNOWN")
    return rows.select(key, "seq", "date", F.col("best.amount").alias("amount"), kind.alias("type"), merchant.alias("merchant"))


def appended(lists: list[DataFrame], key: str = "statement_id") -> DataFrame:
    """Transactions of several sources as one list per statement, source after source, numbered from 0 on."""
    rows = None
    for i, part in enumerate(lists):
        part = part.withColumn("_source", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy(key).orderBy("_source", "seq")) - 1).cast("long")).drop("_source")
