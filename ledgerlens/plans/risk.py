"""Statements to verdicts: parse, features, rules, anomaly, hybrid verdict, takeover, reasons and report in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.storage import written
from ledgerlens.operators import explain, prediction, scoring
from ledgerlens.operators.features import features
from ledgerlens.operators.transactions import parse


def analyse(transactions: DataFrame, key: str = "statement_id", anomaly: Column | None = None, flagged: Column | None = None) -> DataFrame:
    """One row per statement: features, scores, verdict, reasons, recommendation and key metrics.

    ``anomaly`` is a model's score (0 to 1) as a column over the features, ``flagged`` its own verdict, which may be made of
    anomaly_score; without a model the rules decide alone. The feature
    windows, the takeover windows and the categories share the deal by statement.
    """
    dealt = transactions.repartition(key)
    rows = features(dealt, key).join(scoring.takeover(dealt, key), key).join(explain.categories(dealt, key), key)
    rows = rows.withColumn("rule_score", scoring.rule_score()).withColumn("anomaly_score", anomaly if anomaly is not None else F.lit(0.0))
    risk = scoring.calibrated(F.col("anomaly_score")) if anomaly is not None else F.lit(0.0)
    rows = rows.withColumn("model_risk", risk).withColumn("model_flag", flagged if flagged is not None else F.lit(False)).withColumn("_v", scoring.verdict(F.col("rule_score"), F.col("model_risk"), F.col("model_flag")))
    rows = rows.withColumn("risk_score", F.greatest("_v.combined_score", "takeover_score")).withColumn("is_fraud", F.col("_v.is_fraud") | (F.col("takeover_score") >= 70))
    rows = rows.withColumn("hybrid_level", F.col("_v.risk_level")).withColumn("combined_score", F.col("_v.combined_score")).drop("_v")
    found = explain.reasons(F.col("takeover_score"), F.col("categories"))
    rows = rows.withColumn("reasons", found)
    return rows.select(
        "*", scoring.band(F.col("risk_score"), "report").alias("risk_level"), scoring.band(F.col("risk_score"), "confidence").alias("confidence"),
        explain.verdict_text(F.col("risk_score"), F.col("is_fraud")).alias("verdict"), explain.recommendation(F.col("risk_score"), F.col("is_fraud")).alias("recommendation"), explain.key_metrics().alias("key_metrics"),
    )


def analyse_text(statements: DataFrame, detector: prediction.Detector, artifact: str, key: str = "statement_id", text: str = "text") -> DataFrame:
    """Statement text to report: lines to transactions, features, the rules and the saved ``detector``, hybrid verdict, take-over, reasons.

    One row per statement that has any transaction, as of ``analyse``, with the detector's level and what the report says of it.
    """
    # features, take-over and categories need columns of their own, so that each would parse all text again
    transactions = written(parse(statements, key, text), "transactions")
    spark = statements.sparkSession
    rows = analyse(transactions, key, prediction.scores(detector, spark), F.col("anomaly_score") > detector.cut)
    return rows.select("*", scoring.band(F.col("model_risk"), "inference").alias("model_level"), prediction.metadata(detector, artifact).alias("model"))
