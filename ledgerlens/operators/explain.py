"""Reasons, verdict texts and recommendations from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.merchants import category_labels
from ledgerlens.functions.text import format_amount, safe_name

# The texts that consumers of the reports look for.
TAKEOVER = {
    90.0: "Potential account takeover pattern: salary credit followed by rapid cash-out through ATM / transfer / wire activity",
    75.0: "Potential account takeover pattern: salary credit followed by multiple cash-out transactions and transfers",
    60.0: "Suspicious post-salary cash-out activity detected (ATM / transfer sequence)",
}
FALLBACK = "Transaction pattern differs from typical behavior (ML model confidence)"
ADVICE = {
    "urgent": "URGENT: Manual compliance review required. Consider immediate account review, transaction blocking, or escalation to fraud investigation team.",
    "review": "Manual compliance review required. Monitor account closely and investigate flagged transactions. Consider enhanced verification procedures.",
    "enhanced": "Enhanced monitoring recommended. Review flagged patterns and verify account holder identity if suspicious activity continues.",
    "standard": "Continue standard monitoring. Some unusual patterns detected but no immediate action required. Track for trend analysis.",
    "none": "No action required. Transaction pattern is within normal range. Continue standard compliance procedures.",
}


def takeover_reason(score: Column) -> Column:
    return F.coalesce(*[F.when(score == k, v) for k, v in TAKEOVER.items()], F.lit(""))


def categories(transactions: DataFrame, key: str = "statement_id") -> DataFrame:
    """(key, categories): the sorted high-risk categories of a statement's merchants; at most as many as there are categories."""
    found = transactions.select(key, F.explode_outer(category_labels(F.col("merchant"))).alias("c"))
    return found.groupBy(key).agg(F.array_sort(F.collect_set("c")).alias("categories"))


def reasons(takeover_score: Column, labels: Column) -> Column:
    """The reasons for a row of features, in their fixed order."""
    f = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    whole = lambda name: f(name).cast("int").cast("string")
    risky = f("high_risk_merchants")
    plain = F.when(risky > 1, "Multiple transactions with gambling, casino, or crypto merchants").otherwise("A transaction with gambling, casino, or crypto merchants")
    found = [
        F.when(risky >= 1, F.when(F.size(labels) > 0, F.concat(F.lit("Transactions with high-risk merchants detected: "), F.array_join(labels, ", "))).otherwise(plain)),
        F.when(takeover_score >= 70, takeover_reason(takeover_score)),
        F.when((f("high_risk_merchant_ratio") >= 0.5) & (risky < 1), "Sustained trading or crypto activity detected; pattern is consistent but still warrants monitoring"),
        F.when(f("large_debit_transactions") >= 1, F.concat(F.lit("Unusually large withdrawal amount detected (up to "), format_amount(f("max_transaction")), F.lit(")"))),
        F.when(f("rapid_same_merchant_transactions") >= 2, "Multiple rapid transactions to the same merchant within short time window"),
        F.when(f("txn_velocity_5min") >= 1, F.concat(F.lit("Extremely high transaction velocity: "), whole("txn_velocity_5min"), F.lit(" transactions within 5 minutes"))),
        F.when(f("txn_velocity_1hour") >= 3, F.concat(F.lit("High transaction frequency: "), whole("txn_velocity_1hour"), F.lit(" transactions within 1 hour"))),
        F.when(f("amount_spike_ratio") >= 5, F.concat(F.lit("Abnormal spending spike detected ("), F.format_string("%.1f", f("amount_spike_ratio")), F.lit("x above average)"))),
        F.when(f("high_value_transactions") >= 3, F.concat(F.lit("Multiple high-value transactions detected ("), whole("high_value_transactions"), F.lit(")"))),
        F.when(f("avg_txn_per_day") >= 10, F.concat(F.lit("Unusually high transaction frequency ("), F.format_string("%.1f", f("avg_txn_per_day")), F.lit(" transactions per day)"))),
        F.when(f("cash_like_activity") >= 2, "Multiple ATM or cash-equivalent transactions detected"),
        F.when(f("transaction_std_dev") >= 20000, "High variation in transaction amounts (inconsistent spending pattern)"),
        F.when(f("max_amount_zscore") >= 3, F.concat(F.lit("Transaction amount significantly deviates from normal pattern (z-score: "), F.format_string("%.1f", f("max_amount_zscore")), F.lit(")"))),
    ]
    some = F.filter(F.array(*found), lambda r: r.isNotNull())
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(FALLBACK)))


def verdict_text(score: Column, fraud: Column) -> Column:
    return (
        F.when(fraud & (score >= 70), "HIGH RISK - Fraudulent activity strongly suspected")
        .when(fraud, "MEDIUM RISK - Suspicious activity detected")
        .when(score >= 45, "MEDIUM RISK - Some unusual patterns detected")
        .otherwise("LOW RISK - Activity appears normal")
    )


def recommendation(score: Column, fraud: Column) -> Column:
    return (
        F.when(fraud & (score >= 70), ADVICE["urgent"])
        .when(fraud & (score >= 45), ADVICE["review"])
        .when(score >= 45, ADVICE["enhanced"])
        .when(score >= 35, ADVICE["standard"])
        .otherwise(ADVICE["none"])
    )


def normalised_recommendation(text: Column, score: Column, fraud: Column) -> Column:
    """A given recommendation unless it is empty or more urgent than the score allows."""
    low = F.lower(F.btrim(F.coalesce(text, F.lit(""))))
    urgent = low.rlike("urgent|immediate action|immediate account review|account suspension")
    too_much = (low == "") | ((score < 70) & urgent) | ((score < 45) & F.contains(low, F.lit("manual compliance review required")))
    return F.when(too_much, recommendation(score, fraud)).otherwise(F.btrim(text))


def key_metrics() -> Column:
    whole = lambda name: F.coalesce(F.col(name), F.lit(0.0)).cast("int")
    money = lambda name: F.round(F.coalesce(F.col(name), F.lit(0.0)), 2)
    return F.struct(
        whole("total_transactions").alias("total_transactions"), money("total_debited").alias("total_debited"), money("total_credited").alias("total_credited"), whole("high_risk_merchants").alias("high_risk_merchants"),
        money("max_transaction").alias("max_transaction_amount"), whole("unique_merchants").alias("unique_merchants"),
        F.greatest(whole("txn_velocity_5min"), whole("rapid_same_merchant_transactions")).alias("rapid_transactions"), whole("large_debit_transactions").alias("large_debits"),
    )


def report_id(name: Column, stamp: Column) -> Column:
    clean = safe_name(F.coalesce(name, F.lit("")))
    return F.when(clean != "", F.concat(F.lit("RISK_REPORT_"), clean, F.lit("_"), stamp)).otherwise(F.concat(F.lit("RISK_REPORT_"), stamp))


def summary_line(level: Column, score: Column, name: Column, issues: Column) -> Column:
    """One line: level, score, file, the first three issues and how many more there are."""
    more = F.when(F.size(issues) > 3, F.concat(F.lit(" (+"), (F.size(issues) - 3).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat_ws(" | ", level, F.concat(F.format_string("%.1f", score), F.lit("/100")), name, F.concat(F.array_join(F.slice(issues, 1, 3), "; "), more))
