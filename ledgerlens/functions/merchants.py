"""Merchant and keyword predicates as column expressions; one alternation each, so that a row is scanned once per predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists that the scores are defined by.
HIGH_RISK = ["casino", "gambling", "betting", "lottery", "atm", "nightclub", "bar", "adult", "money transfer", "wire transfer"]
SENSITIVE = ["crypto", "bitcoin", "forex"]
LEGITIMATE = [
    "salary", "payroll", "employer", "emi", "loan", "installment", "repayment", "refund", "interest", "dividend", "government", "utility", "school",
    "hospital", "insurance", "mortgage", "rent", "grocery", "groceries", "pharmacy", "supermarket", "amazon", "amzn", "flipkart", "uber", "swiggy", "zomato",
    "netflix", "spotify", "google", "apple", "microsoft", "restaurant", "food", "petrol", "gas", "electricity", "water", "internet", "mobile", "phone",
]
CASH_LIKE = ["atm", "cash", "withdrawal", "transfer"]
CASH_OUT = ["atm", "cash withdrawal", "withdrawal", "transfer", "wire transfer", "unknown transfer", "intl", "international"]
TRANSFERS = ["transfer", "wire transfer", "unknown transfer", "intl", "international"]
CATEGORIES = [
    ("casino", "Casinos"), ("gambling", "Gambling"), ("crypto", "Cryptocurrency exchanges"), ("bitcoin", "Cryptocurrency exchanges"), ("forex", "Forex trading"),
    ("betting", "Betting sites"), ("lottery", "Lottery"), ("atm", "ATM withdrawals"), ("nightclub", "Nightclubs"), ("adult", "Adult entertainment"),
]


def word_start(merchant: Column, keywords: list[str]) -> Column:
    """Whether a keyword begins a word of the merchant ("bar" in "Barnes")."""
    return F.lower(F.coalesce(merchant, F.lit(""))).rlike(r"(?U)\b(?:" + "|".join(keywords) + ")")


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether a keyword is anywhere in the text ("atm" in "batman")."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(keywords))


def is_high_risk(merchant: Column) -> Column:
    return word_start(merchant, HIGH_RISK)


def is_sensitive(merchant: Column) -> Column:
    return word_start(merchant, SENSITIVE)


def is_legitimate(merchant: Column) -> Column:
    return word_start(merchant, LEGITIMATE)


def is_cash_like(merchant: Column) -> Column:
    return contains_any(merchant, CASH_LIKE)


def category_labels(merchant: Column) -> Column:
    """Distinct sorted categories whose keyword is in the merchant."""
    low = F.lower(F.coalesce(merchant, F.lit("")))
    found = F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(c)) for k, c in CATEGORIES])
    return F.array_sort(F.array_distinct(F.filter(found, lambda c: c.isNotNull())))
