"""The engine from SQL alone: views over a session's transactions and chunks, and functions for scores, bands, verdicts and search.

Functions have SQL bodies, so that Catalyst puts them into the plan like any expression; the ones that need a statement's features are
views. After ``register`` a whole analysis is a SELECT, e.g.

    SELECT statement_id, risk_band(risk_score, 'report') FROM statement_risk
    SELECT * FROM nearest_chunks(array(0.1D, 0.2D), 5)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import tables
from ledgerlens.operators import explain, scoring
from ledgerlens.operators.features import features

#: What the rule score is made of, each with its type, all null-safe.
RULE_INPUTS = ["high_risk_merchants", "high_risk_merchant_ratio", "large_debit_transactions", "rapid_same_merchant_transactions", "cash_like_activity", "txn_velocity_5min", "txn_velocity_1hour", "amount_spike_ratio", "transaction_std_dev", "avg_txn_per_day", "max_amount_zscore", "legitimate_merchants"]


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cases(branches: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {quoted(value)}" for test, value in branches) + f" ELSE {quoted(otherwise)} END"


def band_body() -> str:
    of = lambda table: cases([(f"score >= {scoring.BANDS[table][1]}D", scoring.BANDS[table][2][2]), (f"score >= {scoring.BANDS[table][0]}D", scoring.BANDS[table][2][1])], scoring.BANDS[table][2][0])
    return "CASE kind " + " ".join(f"WHEN '{t}' THEN {of(t)}" for t in scoring.BANDS) + " END"


RULE_BODY = """greatest(0D, least(100D, 10 * coalesce(high_risk_merchants, 0D) + 75 * coalesce(high_risk_merchant_ratio, 0D) + coalesce(large_debit_transactions, 0D) + 5 * coalesce(rapid_same_merchant_transactions, 0D)
  + coalesce(cash_like_activity, 0D) + 8 * coalesce(txn_velocity_5min, 0D) + 2 * coalesce(txn_velocity_1hour, 0D) + greatest(0D, 0.5D * (coalesce(amount_spike_ratio, 0D) - 20)) + 0.0001D * coalesce(transaction_std_dev, 0D)
  + greatest(0D, coalesce(avg_txn_per_day, 0D) - 15) + greatest(0D, 2 * (coalesce(max_amount_zscore, 0D) - 3)) - least(5 * coalesce(legitimate_merchants, 0D), 30D)))"""

FUNCTIONS = {
    "rule_score(" + ", ".join(f"{c} DOUBLE" for c in RULE_INPUTS) + ") RETURNS DOUBLE": RULE_BODY,
    "risk_band(score DOUBLE, kind STRING) RETURNS STRING": band_body(),
    "calibrated_risk(anomaly DOUBLE, midpoint DOUBLE DEFAULT 0.58D) RETURNS DOUBLE": "greatest(0D, least(1D, 1 / (1 + exp(-8 * (anomaly - midpoint)))))",
    "combined_score(rule DOUBLE, risk DOUBLE) RETURNS DOUBLE": "round(0.2D * greatest(0D, least(100D, rule)) + 0.8D * greatest(0D, least(100D, 100 * greatest(risk, 0D))), 4)",
    "hybrid_fraud(rule DOUBLE, risk DOUBLE, flagged BOOLEAN) RETURNS BOOLEAN": "risk >= 0.9D OR rule >= 75 OR (combined_score(rule, risk) >= 55 AND (risk >= 0.6D OR rule >= 45)) OR (flagged AND (risk >= 0.55D OR rule >= 20))",
    "hybrid_level(rule DOUBLE, risk DOUBLE) RETURNS STRING": cases([("combined_score(rule, risk) >= 70 OR risk >= 0.75D OR rule >= 75", "high"), ("combined_score(rule, risk) >= 50 OR risk >= 0.5D OR rule >= 50", "medium")], "low"),
    "risk_verdict_text(score DOUBLE, fraud BOOLEAN) RETURNS STRING": cases([("fraud AND score >= 70", "HIGH RISK - Fraudulent activity strongly suspected"), ("fraud", "MEDIUM RISK - Suspicious activity detected"), ("score >= 45", "MEDIUM RISK - Some unusual patterns detected")], "LOW RISK - Activity appears normal"),
    "risk_recommendation(score DOUBLE, fraud BOOLEAN) RETURNS STRING": cases([("fraud AND score >= 70", explain.ADVICE["urgent"]), ("fraud AND score >= 45", explain.ADVICE["review"]), ("score >= 45", explain.ADVICE["enhanced"]), ("score >= 35", explain.ADVICE["standard"])], explain.ADVICE["none"]),
    "unit_vector(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "transform(v, x -> x / (sqrt(aggregate(v, 0D, (a, y) -> a + y * y)) + 1e-10D))",
    "vector_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "1 / (1 + aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
}

#: The verdict by the rules alone, on top of the registered views.
STATEMENT_RISK = f"""
SELECT *, greatest(combined, takeover_score) AS risk_score, hybrid_fraud(rule, 0D, false) OR takeover_score >= 70 AS is_fraud FROM (
  SELECT *, combined_score(rule, 0D) AS combined FROM (
    SELECT f.*, t.takeover_score, rule_score({", ".join(f"f.{c}" for c in RULE_INPUTS)}) AS rule FROM statement_features f JOIN statement_takeover t USING (statement_id)))"""


def functions(spark: SparkSession) -> None:
    """All scalar functions and the table functions that need no view."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    tables.register(spark)


def register(spark: SparkSession, transactions: DataFrame | None = None, chunks: DataFrame | None = None, key: str = "statement_id") -> None:
    """Functions, and views over what is given: statement_features, statement_takeover and statement_risk of ``transactions``; chunk_vectors
    and the table function nearest_chunks(query, k) of ``chunks`` (document_id, chunk_id, vector).
    """
    functions(spark)
    if transactions is not None:
        dealt = transactions.withColumnRenamed(key, "statement_id")
        dealt.createOrReplaceTempView("transactions")
        features(dealt).createOrReplaceTempView("statement_features")
        scoring.takeover(dealt).createOrReplaceTempView("statement_takeover")
        spark.sql(STATEMENT_RISK).createOrReplaceTempView("statement_risk")
    if chunks is not None:
        chunks.select("document_id", "chunk_id", F.col("vector").cast("array<double>").alias("vector")).createOrReplaceTempView("chunk_vectors")
        spark.sql(
            """CREATE OR REPLACE TEMPORARY FUNCTION nearest_chunks(query ARRAY<DOUBLE>, k INT) RETURNS TABLE (document_id STRING, chunk_id STRING, similarity DOUBLE, rank INT)
            RETURN SELECT document_id, chunk_id, similarity, rank FROM (
              SELECT CAST(document_id AS STRING) AS document_id, CAST(chunk_id AS STRING) AS chunk_id, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, chunk_id) AS INT) AS rank
              FROM (SELECT document_id, chunk_id, vector_similarity(unit_vector(vector), unit_vector(nearest_chunks.query)) AS similarity FROM chunk_vectors)) WHERE rank <= nearest_chunks.k"""
        )
