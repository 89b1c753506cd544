"""Rounded figures in reports, as doubles are rounded."""

from pyspark.sql import functions as F

from ledgerlens.functions.text import rounded
from ledgerlens.operators import answers

DECIMALS = [19.955, 19.455, 17.115, 16.1745, 2.675, 1.115, 0.5, -0.005, -2.675, 0.0, 99.995]


def half_away(x, digits):
    y = x * 10.0**digits
    return (int(abs(y) + 0.5) if abs(y) + 0.5 < 2**52 else abs(y)) * (-1 if y < 0 else 1) / 10.0**digits


def test_doubles_are_rounded_as_such(spark):
    rows = spark.createDataFrame([(x,) for x in DECIMALS], "x double").select("x", rounded(F.col("x"), 2).alias("two"), rounded(F.col("x"), 3).alias("three")).collect()
    assert [(r["two"], r["three"]) for r in rows] == [(half_away(r["x"], 2), half_away(r["x"], 3)) for r in rows]
    assert rows[0]["two"] == 19.95
    assert spark.range(1).select(rounded(F.lit(None).cast("double"), 2)).first()[0] is None


def test_report_scores_are_rounded_as_doubles(spark):
    metrics = F.struct(*[F.lit(1.0).alias(c) for _, c, _ in answers.METRICS])
    row = spark.createDataFrame([(19.955,)], "risk_score double").select(
        "risk_score", F.lit("r").alias("report_id"), F.lit("d").alias("generated"), F.lit("n").alias("document_name"), F.lit("LOW").alias("risk_level"), F.lit(0.0).alias("model_risk"),
        F.lit(False).alias("is_fraud"), F.array(F.lit("why")).alias("reasons"), metrics.alias("key_metrics"), F.lit("none").alias("recommendation"),
    )
    r = row.select(answers.text_report().alias("text"), answers.summary_report().alias("line")).first()
    assert "Risk Level: LOW (19.95/100)" in r["text"] and "Risk Score: 19.95/100" in r["line"]


def test_prompt_scores_are_rounded_as_decimals(spark):
    a, b = 0.7 + 0.3 * 0.65, 0.8949999999999999  # both stand for 0.895
    shown = spark.createDataFrame([(a,), (b,), (0.8949,)], "s double").select(answers.section(F.lit(1), F.lit(0), F.lit(""), F.col("s"), F.col("s"), F.lit("x")).alias("t")).collect()
    assert [r["t"].split("\n")[1] for r in shown] == [f"[Section 1] (Relevance: {x}, Confidence: {x})" for x in ("0.90", "0.90", "0.89")]
