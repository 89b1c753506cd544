"""The anomaly detector as one operator: features, alignment, scaling, forest, calibrated risk and level."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.storage import written

from . import learning
from .features import FEATURES, vector
from .scoring import band, calibrated

VERSION = "hybrid-v2"


@dataclass
class Detector:
    """An isolation forest over scaled features: names, means and deviations by place, trees, and the score above which a row is an outlier."""

    names: list[str]
    means: list[float]
    deviations: list[float]
    trees: list[dict] = field(repr=False)
    cut: float = 0.5


def fit(rows: DataFrame, names: list[str], key: str, trees: int = 200, contamination: float = 0.05) -> Detector:
    """Scaling by mean and deviation, a forest, and the 1 - contamination quantile of the rows' own scores."""
    rows = written(rows.select(key, *names), "detector")  # several passes follow
    by = learning.moments(rows, names)
    scaled = learning.standardise(rows, names, by)
    forest = learning.isolation_trees(scaled, names, key, trees)
    scored = scaled.select(learning.anomaly_score(forest, names, rows.sparkSession).alias("s"))
    cut = scored.agg(F.percentile_approx("s", 1 - contamination, 100_000)).first()[0]
    return Detector(list(names), [by[c][0] for c in names], [by[c][1] for c in names], forest, float(cut if cut is not None else 0.5))


def alignment(given: int, expected: int) -> str:
    return "none" if given == expected else "padded" if given < expected else "truncated"


def scores(detector: Detector, spark: SparkSession, names: list[str] | None = None) -> Column:
    """The anomaly score of a row of features: in model order, padded with zeros or cut to the detector's width, and scaled."""
    scale = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in zip(detector.means, detector.deviations, strict=True)])
    x = F.zip_with(vector(names or FEATURES, len(detector.names)), scale, lambda v, s: (v - s["m"]) / s["d"])
    return learning.anomaly_score(detector.trees, x, spark)


def predict(rows: DataFrame, detector: Detector, key: str = "statement_id", names: list[str] | None = None) -> DataFrame:
    """(key, anomaly_score, risk_score, is_fraud, risk_level, feature_alignment_action) of every row of features.

    The features, in model order, are padded with zeros or cut to the detector's width, which the action tells. One row is a batch of one.
    """
    names = names or FEATURES
    width = len(detector.names)
    scored = rows.select(key, scores(detector, rows.sparkSession, names).alias("anomaly_score"))
    risk = calibrated(F.col("anomaly_score"))
    return scored.select(key, "anomaly_score", risk.alias("risk_score"), (F.col("anomaly_score") > detector.cut).alias("is_fraud"), band(risk, "inference").alias("risk_level"), F.lit(alignment(len(names), width)).alias("feature_alignment_action"))


def metadata(detector: Detector, artifact: str, names: list[str] | None = None) -> Column:
    """What a report says of the model: version, artefact, expected and given features, and the alignment."""
    given, expected = len(names or FEATURES), len(detector.names)
    return F.struct(
        F.lit(VERSION).alias("pipeline_version"), F.lit(artifact).alias("model_artifact"), F.lit(artifact).alias("scaler_artifact"), F.lit(expected).alias("expected_feature_count"),
        F.lit(given).alias("provided_feature_count"), F.lit(alignment(given, expected)).alias("feature_alignment_action"),
    )


TREE = "tree int, n int, feature array<int>, cut array<double>, low array<int>, high array<int>, depth array<double>"


def save(spark: SparkSession, detector: Detector, path: str) -> None:
    """Trees as Parquet, names, scaling and cut as JSON, below ``path``."""
    spark.createDataFrame([tuple(t[c.split()[0]] for c in TREE.split(", ")) for t in detector.trees], TREE).write.mode("overwrite").parquet(f"{path}/trees")
    rest = {"names": detector.names, "means": detector.means, "deviations": detector.deviations, "cut": detector.cut}
    spark.createDataFrame([(json.dumps(rest),)], "value string").write.mode("overwrite").text(f"{path}/detector")


def load(spark: SparkSession, path: str) -> Detector:
    rest = json.loads(spark.read.text(f"{path}/detector").first()["value"])
    trees = [r.asDict() for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]  # of bounded number and size
    return Detector(rest["names"], rest["means"], rest["deviations"], trees, rest["cut"])
