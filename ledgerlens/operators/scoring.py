"""Scores and verdicts as column expressions over a row of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import merchants as m

from .features import completed

# Cuts of the band tables, (low, high).
BANDS = {
    "detector": (0.4, 0.7, ["LOW", "MEDIUM", "HIGH"]),
    "inference": (0.3, 0.6, ["low", "medium", "high"]),
    "report": (45.0, 70.0, ["LOW", "MEDIUM", "HIGH"]),
    "confidence": (45.0, 70.0, ["Low", "Medium", "High"]),
    "prompt": (45.0, 70.0, ["LOW", "MEDIUM", "HIGH"]),
    "gauge": (40.0, 70.0, ["green", "yellow", "red"]),
}


def band(score: Column, table: str) -> Column:
    low, high, names = BANDS[table]
    return F.when(score >= high, names[2]).when(score >= low, names[1]).otherwise(names[0])


def percent(score: Column) -> Column:
    """Scores up to 1 are shares."""
    return F.when(score <= 1, score * 100).otherwise(score)


def dashboard_level(score: Column, reason: Column) -> Column:
    """Wording of an account takeover is always high."""
    return F.when(F.contains(F.lower(F.coalesce(reason, F.lit(""))), F.lit("account takeover")), "HIGH").otherwise(band(percent(score), "report"))


#: Wording of a reason that raises a report on the dashboard.
OVERRIDES = ["account takeover", "cash-out", "cash out"]


def dashboard(score: Column, fraud: Column, reasons: Column) -> Column:
    """Struct of score (0 to 100), level, override (a reason speaks of a take-over or cash-out) and fraud_flag (shown for fraud that is high or overridden)."""
    shown = percent(F.coalesce(score, F.lit(0.0)))
    override = F.coalesce(F.exists(reasons, lambda r: F.lower(F.coalesce(r, F.lit(""))).rlike("|".join(OVERRIDES))), F.lit(False))
    level = F.when(override, "HIGH").otherwise(band(shown, "report"))
    return F.struct(shown.alias("score"), level.alias("level"), override.alias("override"), (F.coalesce(fraud, F.lit(False)) & ((shown >= 70) | override)).alias("fraud_flag"))




def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rule_score() -> Column:
    """0 to 100 from a row of features; null features count as 0."""
    f = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    over = lambda name, cut, weight: F.when(f(name) > cut, weight * (f(name) - cut)).otherwise(0.0)
    total = (
        10 * f("high_risk_merchants") + 75 * f("high_risk_merchant_ratio") + f("large_debit_transactions") + 5 * f("rapid_same_merchant_transactions") + f("cash_like_activity")
        + 8 * f("txn_velocity_5min") + 2 * f("txn_velocity_1hour") + over("amount_spike_ratio", 20, 0.5) + 0.0001 * f("transaction_std_dev")
        + over("avg_txn_per_day", 15, 1.0) + over("max_amount_zscore", 3, 2.0) - F.least(5 * f("legitimate_merchants"), F.lit(30.0))
    )
    return clamp(total, 0.0, 100.0)


def calibrated(anomaly: Column, midpoint: float = 0.58) -> Column:
    """An anomaly score as a risk from 0 to 1."""
    return clamp(1 / (1 + F.exp(-8 * (anomaly - midpoint))), 0.0, 1.0)


def combined_score(rule: Column, risk: Column) -> Column:
    return F.round(0.2 * clamp(rule, 0.0, 100.0) + 0.8 * clamp(100 * F.greatest(risk, F.lit(0.0)), 0.0, 100.0), 4)


def verdict(rule: Column, risk: Column, flagged: Column) -> Column:
    """Struct of combined_score, is_fraud and risk_level."""
    f, a, c = clamp(rule, 0.0, 100.0), F.greatest(risk, F.lit(0.0)), combined_score(rule, risk)
    fraud = (a >= 0.9) | (f >= 75) | ((c >= 55) & ((a >= 0.6) | (f >= 45))) | (flagged & ((a >= 0.55) | (f >= 20)))
    level = F.when((c >= 70) | (a >= 0.75) | (f >= 75), "high").when((c >= 50) | (a >= 0.5) | (f >= 50), "medium").otherwise("low")
    return F.struct(c.alias("combined_score"), fraud.alias("is_fraud"), level.alias("risk_level"))


def takeover(transactions: DataFrame, key: str = "statement_id") -> DataFrame:
    """(key, takeover_score, takeover_pattern) of every statement: a credit followed by cash-outs."""
    rows = completed(transactions)
    kind, text = F.lower(F.coalesce("type", F.lit(""))), F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("merchant", F.lit("")))
    rows = rows.select(key, "seq", (kind == "debit").alias("debit"), F.when(kind == "credit", F.col("seq")).alias("credit_at"), m.contains_any(text, m.CASH_OUT).alias("out"), m.contains_any(text, m.TRANSFERS).alias("moved"))
    whole = Window.partitionBy(key)
    rows = rows.withColumn("first_credit", F.min("credit_at").over(whole)).withColumn("after", F.col("seq") > F.col("first_credit"))
    rows = rows.withColumn("late", F.coalesce(F.col("after") & F.col("debit"), F.lit(False)))
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy(key, "late").orderBy(F.desc("seq"))))
    n = F.count_if
    a = rows.groupBy(key).agg(F.count("*").alias("n"), n(F.col("after")).alias("rest"), n(F.col("late") & F.col("out")).alias("outs"), n(F.col("late") & F.col("moved")).alias("moves"), n(F.col("late") & F.col("out") & (F.col("back") <= 3)).alias("recent"))
    able = (F.col("n") >= 4) & (F.col("rest") >= 3)
    score = F.when(able & (F.col("moves") >= 2) & (F.col("recent") >= 2), 90.0).when(able & (F.col("outs") >= 2) & (F.col("recent") >= 2), 75.0).when(able & (F.col("outs") >= 1) & (F.col("recent") >= 1) & (F.col("moves") >= 1), 60.0).otherwise(0.0)
    return a.select(key, score.alias("takeover_score"))
