"""Supervised models on labelled rows: fit, compare, learning curve and business ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.storage import written
from ledgerlens.operators import learning
from ledgerlens.operators.history import running_rank
from ledgerlens.sources.readers import write_metrics


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with weight: each class weighs as much as the other."""
    n = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # a row per class
    total = sum(n.values())
    return rows.withColumn("weight", F.coalesce(*[F.when(F.col(label) == k, total / (len(n) * c)) for k, c in n.items()], F.lit(1.0)))


def estimators(seed: int = 42, trees: int = 300) -> dict:
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic_regression": LogisticRegression(maxIter=2000, **common),
        "random_forest": RandomForestClassifier(numTrees=trees, seed=seed, **common),
        "gradient_boosting": GBTClassifier(featuresCol="features", labelCol="label", seed=seed),
    }


def fit(rows: DataFrame, columns: list[str], name: str, trees: int = 300) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), estimators(trees=trees)[name]]).fit(rows)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with score (of class 1) and predicted."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).withColumn("predicted", F.col("prediction").cast("int"))


#: The detector among the models: it learns without labels.
ISOLATION = "isolation_forest"


def outlier_scores(train: DataFrame, test: DataFrame, columns: list[str], key: str, trees: int, contamination: float) -> DataFrame:
    """``test`` with score and predicted of an isolation forest grown on ``train``."""
    spark = train.sparkSession
    forest = learning.isolation_trees(train, columns, key, min(trees, 200))
    cut = train.select(learning.anomaly_score(forest, columns, spark).alias("s")).agg(F.percentile_approx("s", 1 - contamination, 100_000)).first()[0]
    found = test.withColumn("score", learning.anomaly_score(forest, columns, spark))
    return found.withColumn("predicted", (F.col("score") > F.lit(cut)).cast("int"))


def compare(rows: DataFrame, columns: list[str], key: str, names: list[str] | None = None, trees: int = 300, contamination: float = 0.05) -> DataFrame:
    """One row per model with metrics on the held-out fifth, train_accuracy, business_score and rank.

    Scaling and median imputation come from the training rows. Both parts are written once; every fit and every metric reads them.
    """
    split = learning.stratified_split(rows, "label", key).select(key, "label", "is_test", *columns)
    split = written(split, "split")
    train = split.where("not is_test")
    medians = {c: v[0] for c, v in learning.quantiles_of(train, columns, [0.5]).items() if v[0] is not None}
    split = split.fillna(medians)
    by = learning.moments(split.where("not is_test"), columns)
    split = written(learning.standardise(split, columns, by), "scaled")
    train, test = balanced(split.where("not is_test"), "label"), split.where("is_test")
    parts = []
    for name in names or [*estimators(), ISOLATION]:
        if name == ISOLATION:
            own, found = (outlier_scores(train, part, columns, key, trees, contamination) for part in (train, test))
        else:
            model = fit(train, columns, name, trees)
            own, found = scored(model, train), scored(model, test)
        found = written(found.select("label", "score", "predicted"), "scored")
        metrics = learning.classification_metrics(found, "label", "predicted").withColumn("model", F.lit(name)).withColumnRenamed("accuracy", "test_accuracy")
        accuracy = own.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("train_accuracy")).withColumn("model", F.lit(name))
        parts.append(metrics.join(accuracy, "model").join(learning.areas(found, "label", "score").withColumn("model", F.lit(name)), "model"))
    table = reduce(DataFrame.unionByName, parts).withColumn("business_score", learning.business_score(F.col("recall"), F.col("precision"), F.col("roc_auc")))
    return running_rank(written(table, "models"), ["business_score", "recall", "precision", "roc_auc"])


def learning_curve(rows: DataFrame, columns: list[str], key: str, name: str = "logistic_regression", sizes: tuple = (0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 3, most: int = 50_000, trees: int = 300) -> DataFrame:
    """(share, rows, train_f1, valid_f1): means over ``folds`` for growing shares of at most ``most`` rows, a documented bound.

    Folds are dealt by the hash of the key within each label, as many as the rarer label has rows at most; no rows for fewer than two.
    """
    chosen = learning.downsample(rows.select(key, "label", *columns), key, most)
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.col(key), F.lit(11)), key)  # at most ``most`` rows
    chosen = written(chosen.withColumn("_i", F.row_number().over(order)), "curve")
    counts = [r["count"] for r in chosen.groupBy("label").count().collect()]  # a row per label
    folds = min(folds, *counts) if len(counts) > 1 else 0
    spark = rows.sparkSession
    if folds < 2:
        return spark.createDataFrame([], "share double, rows bigint, train_f1 double, valid_f1 double")
    chosen = written(learning.impute_median(chosen, columns).withColumn("_fold", F.col("_i") % folds).withColumn("_h", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1000)) / 1000.0), "folds")
    parts = []
    for share in sizes:
        for fold in range(folds):
            part = balanced(chosen.where((F.col("_fold") != fold) & (F.col("_h") < share)), "label")
            model = fit(part, columns, name, trees)
            both = scored(model, part.select(*chosen.columns).withColumn("_train", F.lit(True)).unionByName(chosen.where(F.col("_fold") == fold).withColumn("_train", F.lit(False))))
            metrics = learning.classification_metrics(both, "label", "predicted", ["_train"])
            parts.append(metrics.select(F.lit(share).alias("share"), F.expr("tp + fp + fn + tn").alias("rows"), "_train", "f1"))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("share").agg(F.floor(F.avg(F.when(F.col("_train"), F.col("rows")))).alias("rows"), F.avg(F.when(F.col("_train"), F.col("f1"))).alias("train_f1"), F.avg(F.when(~F.col("_train"), F.col("f1"))).alias("valid_f1"))


def save_model(model: PipelineModel, path: str, columns: list[str], metrics: DataFrame) -> None:
    """A fitted pipeline, its feature names in order and its metrics below ``path``."""
    model.write().overwrite().save(f"{path}/model")
    spark = metrics.sparkSession
    spark.createDataFrame(list(enumerate(columns)), "place int, feature string").coalesce(1).write.mode("overwrite").json(f"{path}/features")
    write_metrics(metrics, path)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    names = [r["feature"] for r in spark.read.json(f"{path}/features").orderBy("place").collect()]  # a row per feature
    return PipelineModel.load(f"{path}/model"), names
