"""Retrieval evaluation: results against test cases, their summary and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import relevance

#: Results that the gain and the precision look at.
DEPTH = 5


def evaluate(cases: DataFrame, results: DataFrame) -> DataFrame:
    """A row per test case: (case_id, retrieved_chunks, relevant_chunks, mrr, ndcg, p_at_5, latency_ms, success).

    ``cases``: case_id, keywords; ``results``: case_id, rank (from 1 on), content, latency_ms. They are joined by case_id, never by position. A result
    is relevant if it holds a keyword; gains are discounted by the root of the rank and compared with all of the first five being relevant.
    Cases without results have zeros and no success.
    """
    rows = results.join(cases.select("case_id", "keywords"), "case_id").withColumn("_r", relevance(F.col("content"), F.col("keywords")))
    first, gain = F.col("rank") <= DEPTH, F.when(F.col("_r"), 1.0).otherwise(0.0)
    per = rows.groupBy("case_id").agg(
        F.count("*").alias("retrieved_chunks"), F.count_if("_r").alias("relevant_chunks"), F.coalesce(1 / F.min(F.when(F.col("_r"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        (F.sum(F.when(first, gain / F.sqrt("rank"))) / F.sum(F.when(first, 1 / F.sqrt("rank")))).alias("ndcg"), F.avg(F.when(first, gain)).alias("p_at_5"), F.max("latency_ms").alias("latency_ms"),
    )
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)
    joined = cases.select("case_id").join(per, "case_id", "left")
    return joined.select(
        "case_id", zero("retrieved_chunks", "bigint"), zero("relevant_chunks", "bigint"), zero("mrr", "double"), zero("ndcg", "double"), zero("p_at_5", "double"), zero("latency_ms", "double"),
        (F.coalesce("relevant_chunks", F.lit(0)) > 0).alias("success"),
    )


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: tests, successes and their share, and the means of the metrics."""
    n, good = F.count("*"), F.count_if("success")
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return evaluated.agg(
        n.alias("total_tests"), good.alias("successful"), F.when(n > 0, good / n).otherwise(0.0).alias("success_rate"),
        mean("mrr", "mean_reciprocal_rank"), mean("ndcg", "mean_ndcg"), mean("p_at_5", "mean_precision_at_5"), mean("latency_ms", "mean_latency_ms"),
    )


def write_report(evaluated: DataFrame, path: str) -> None:
    """The summary and the results of all cases as JSON lines below ``path``."""
    summary(evaluated).write.mode("overwrite").json(f"{path}/summary")
    evaluated.write.mode("overwrite").json(f"{path}/results")
