"""The thirty behavioural features of a statement: one shuffle by statement, windows over it, one aggregate on top.

Nothing is collected per statement: the median and the 0.75-index threshold come from row numbers, the repeats from lags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import merchants as m
from ledgerlens.functions.dates import day_of, instant

#: The features in the order of the model's input.
FEATURES = [
    "total_transactions", "total_debits", "total_credits", "debit_credit_ratio", "avg_txn_per_day", "avg_transaction_amount", "max_transaction", "min_transaction",
    "transaction_std_dev", "median_transaction", "high_value_transactions", "max_amount_zscore", "high_risk_merchants", "legitimate_merchants", "unique_merchants",
    "merchant_concentration", "rapid_same_merchant_transactions", "cash_like_activity", "large_debit_transactions", "total_debited", "total_credited", "avg_debit_amount",
    "avg_credit_amount", "high_risk_merchant_ratio", "debit_amount_share", "txn_velocity_5min", "txn_velocity_1hour", "txn_velocity_24hour", "amount_spike_ratio", "max_to_median_ratio",
]
#: Columns that a transaction may lack.
OPTIONAL = {"date": "string", "timestamp": "string", "description": "string", "merchant": "string", "type": "string", "amount": "double"}


def completed(transactions: DataFrame) -> DataFrame:
    """With null for every optional column that isn't there."""
    return transactions.select("*", *[F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items() if c not in transactions.columns])


def marked(transactions: DataFrame, key: str = "statement_id") -> DataFrame:
    """Each transaction with what the aggregates need of it; an amount of 0 counts as none."""
    rows = completed(transactions)
    kind = F.lower(F.coalesce("type", F.lit("")))
    amount = F.when(F.col("amount") != 0, F.col("amount").cast("double"))
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    return rows.select(
        key, "seq", amount.alias("amount"), (kind == "debit").alias("debit"), (kind == "credit").alias("credit"), F.coalesce("merchant", F.lit("")).alias("merchant"),
        day_of(first("date", "timestamp")).alias("day"), instant(first("timestamp", "date")).alias("ts"),
        m.is_high_risk(F.col("merchant")).alias("high_risk"), m.is_sensitive(F.col("merchant")).alias("sensitive"), m.is_legitimate(F.col("merchant")).alias("legitimate"), m.is_cash_like(F.col("merchant")).alias("cash"),
    ).withColumn("suspicious", ~F.col("legitimate") & ~F.col("sensitive"))


def features(transactions: DataFrame, key: str = "statement_id", statements: DataFrame | None = None) -> DataFrame:
    """``key`` and FEATURES. With ``statements``, those without transactions get zeros."""
    rows = marked(transactions, key)
    whole = Window.partitionBy(key)
    by_seq = Window.partitionBy(key, "suspicious").orderBy("seq")
    by_amount = Window.partitionBy(key).orderBy(F.col("amount").asc_nulls_last())
    some = F.col("amount").isNotNull()
    rows = (
        rows.withColumn("m1", F.lag("merchant", 1).over(by_seq))
        .withColumn("m2", F.lag("merchant", 2).over(by_seq))
        .withColumn("rank", F.row_number().over(by_amount))
        .withColumn("n", F.count("amount").over(whole))
        .withColumn("mean_debit", F.avg(F.when(F.col("debit"), F.col("amount"))).over(whole))
        .withColumn("last", F.max("ts").over(whole))
        .withColumn("threshold", F.max(F.when(some & (F.col("rank") == F.floor(F.col("n") * 0.75) + 1), F.col("amount"))).over(whole))
    )
    count = lambda c: F.count_if(c).cast("double")
    within = lambda span: count(F.col("ts") >= F.col("last") - F.expr(f"interval {span}"))
    middle = some & ((F.col("rank") == F.floor((F.col("n") + 1) / 2)) | (F.col("rank") == F.floor(F.col("n") / 2) + 1))
    repeat = F.col("suspicious") & F.col("m2").isNotNull() & ((F.col("merchant") == F.col("m1")) | (F.col("merchant") == F.col("m2")) | (F.col("m1") == F.col("m2")))
    debited, credited = F.when(F.col("debit"), F.col("amount")), F.when(F.col("credit"), F.col("amount"))
    a = rows.groupBy(key).agg(
        F.count("*").cast("double").alias("total_transactions"), count(F.col("debit")).alias("total_debits"), count(F.col("credit")).alias("total_credits"),
        F.countDistinct("day").cast("double").alias("days"), F.avg("amount").alias("mean"), F.max("amount").alias("largest"), F.min("amount").alias("least"), F.stddev_samp("amount").alias("std"),
        F.avg(F.when(middle, F.col("amount"))).alias("median"), count(F.col("amount") >= F.col("threshold")).alias("high_value_transactions"),
        count(F.col("high_risk")).alias("high_risk_merchants"), count(F.col("legitimate")).alias("legitimate_merchants"), F.countDistinct(F.lower("merchant")).cast("double").alias("unique_merchants"),
        count(repeat).alias("rapid_same_merchant_transactions"), count(F.col("cash")).alias("cash_like_activity"), count(F.col("debit") & (F.col("amount") > 1.5 * F.col("mean_debit"))).alias("large_debit_transactions"),
        F.sum(debited).alias("debited"), F.sum(credited).alias("credited"), F.avg(debited).alias("mean_debited"), F.avg(credited).alias("mean_credited"), count(F.col("high_risk") | F.col("sensitive")).alias("risky"),
        F.count("ts").alias("timed"), F.count("amount").alias("amounts"), within("5 minutes").alias("v5"), within("1 hour").alias("v60"), within("24 hours").alias("v1440"),
    )
    zero = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))
    per = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    timed = lambda c: F.when(F.col("timed") >= 2, F.col(c)).otherwise(0.0)
    several = F.col("amounts") >= 2
    derived: dict[str, Column] = {
        "debit_credit_ratio": F.when(F.col("total_credits") > 0, F.col("total_debits") / F.col("total_credits")).otherwise(F.col("total_debits")),
        "avg_txn_per_day": F.when(F.col("days") > 0, F.col("total_transactions") / F.col("days")).otherwise(F.col("total_transactions")),
        "avg_transaction_amount": zero("mean"), "max_transaction": zero("largest"), "min_transaction": zero("least"), "transaction_std_dev": zero("std"), "median_transaction": zero("median"),
        "max_amount_zscore": per(F.col("largest") - F.col("mean"), zero("std")),
        "merchant_concentration": 1 - F.col("unique_merchants") / F.col("total_transactions"),
        "total_debited": zero("debited"), "total_credited": zero("credited"), "avg_debit_amount": zero("mean_debited"), "avg_credit_amount": zero("mean_credited"),
        "high_risk_merchant_ratio": F.col("risky") / F.col("total_transactions"),
        "debit_amount_share": per(zero("debited"), zero("debited") + zero("credited")),
        "txn_velocity_5min": timed("v5"), "txn_velocity_1hour": timed("v60"), "txn_velocity_24hour": timed("v1440"),
        "amount_spike_ratio": F.when(several, per(F.col("largest"), F.col("mean"))).otherwise(0.0),
        "max_to_median_ratio": F.when(several, per(F.col("largest"), F.col("median"))).otherwise(0.0),
    }
    found = a.select(key, *[derived.get(f, F.col(f)).alias(f) for f in FEATURES])
    if statements is None:
        return found
    every = statements.select(key).distinct()
    return every.join(found, key, "left").select(key, *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES])


def vector(feature_columns: list[str] | None = None, width: int | None = None) -> Column:
    """The features as an array in model order, padded with zeros or cut to ``width``."""
    names = feature_columns or FEATURES
    out = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in names])
    if width is None or width == len(names):
        return out
    return F.slice(out, 1, width) if width < len(names) else F.concat(out, F.array_repeat(F.lit(0.0), width - len(names)))
