"""Requests checked as rows, before they reach a query: what is missing or malformed, all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import stripped

#: Answer to a request that lacks something.
BAD_REQUEST, OK = 400, 200


def blank(c: Column) -> Column:
    return F.coalesce(stripped(c.cast("string")), F.lit("")) == ""


def fault(test: Column, field: str, message: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def validated(requests: DataFrame, required: list[str], lengths: dict[str, tuple[int, int]] | None = None, ranges: dict[str, tuple[float, float]] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """``requests`` with errors (field and message each, in the order of the rules) and status.

    ``required`` fields must not be null or blank. Fields that are there must have a length in characters, a number, or a shape as
    the other rules say, both ends included; a number that can't be read is out of range.
    """
    found = [fault(blank(F.col(c)), c, f"{c} is required") for c in required]
    for c, (low, high) in (lengths or {}).items():
        n = F.length(stripped(F.col(c).cast("string")))
        found.append(fault(~blank(F.col(c)) & ~n.between(low, high), c, f"{c} must have {low} to {high} characters"))
    for c, (low, high) in (ranges or {}).items():
        x = F.col(c).try_cast("double")
        found.append(fault(~blank(F.col(c)) & (x.isNull() | F.isnan(x) | ~x.between(low, high)), c, f"{c} must be from {low:g} to {high:g}"))
    for c, shape in (patterns or {}).items():
        found.append(fault(~blank(F.col(c)) & ~F.col(c).cast("string").rlike(shape), c, f"{c} is malformed"))
    errors = F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<struct<field:string,message:string>>")
    return requests.withColumn("errors", errors).withColumn("status", F.when(F.size("errors") > 0, BAD_REQUEST).otherwise(OK))


def accepted(checked: DataFrame) -> DataFrame:
    """The requests without faults, as they came."""
    return checked.where(F.size("errors") == 0).drop("errors", "status")
