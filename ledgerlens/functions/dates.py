"""Dates as statements write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of months, short or whole, and the order of the parts of a date, day first.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
YEAR = r"(?!0000)\d{4}"


def tidied(raw: Column) -> Column:
    """A written date with single blanks, without commas."""
    return F.btrim(F.regexp_replace(F.replace(raw, F.lit(","), F.lit("")), r"\s+", " "))


def normalised_date(text: Column) -> Column:
    """yyyy-MM-dd of a tidied date, or null. Two-digit years from 69 on are of the last century.

    The parts are put in the order of a date and cast: a format would be tried by an exception for each day that isn't one.
    """
    low = F.lower(text)
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for name in dict.fromkeys((m[:3], m)) for x in (name, f"-{i}-")])
    named = F.concat(F.right(text, F.lit(4)), names[F.regexp_extract(low, "[a-z]+", 0)], F.regexp_extract(text, r"(\d{1,2}) ", 1))
    day_first = rf"^(\d{{1,2}})([/-])(\d{{1,2}})\2({YEAR})$"
    short = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{2})$"
    parts = (
        F.when(text.rlike(day_first), F.regexp_replace(text, day_first, "$4-$3-$1"))
        .when(text.rlike(rf"^{YEAR}([/-])\d{{1,2}}\1\d{{1,2}}$"), F.replace(text, F.lit("/"), F.lit("-")))
        .when(text.rlike(rf"^(?:\d{{1,2}} [A-Za-z]{{3,}}|[A-Za-z]{{3,}} \d{{1,2}}) {YEAR}$"), named)
        .when(text.rlike(short), F.concat(F.when(F.right(text, F.lit(2)) >= "69", "19").otherwise("20"), F.regexp_replace(text, short, "$4-$3-$1")))
    )
    return parts.try_cast("date").cast("string")


def instant(text: Column) -> Column:
    """A time of day from ISO text with T or a blank, without zone in UTC; null for what has none."""
    return F.when(text.rlike("[T ]"), F.try_to_timestamp(text))


def day_of(text: Column) -> Column:
    """The day of an ISO time or date, or null."""
    return F.coalesce(F.to_date(instant(text)), F.to_date(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}") & ~text.rlike("[T ]"), F.left(text, F.lit(10))), F.lit("yyyy-MM-dd"))))
