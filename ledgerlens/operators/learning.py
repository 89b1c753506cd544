"""Training and evaluation: imputation, scaling, splits, metrics, curves, model ranking and an isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct scores of one range of a running sum, about.
RANGE_ROWS = 500_000
EULER = 0.5772156649015329


def quantiles_of(rows: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of several columns, in three passes for all of them; None for a column without values.

    Approximate quantiles bracket each; only the values between, 4 of 10,000 rows and ties, are counted one by one, by column and share.
    """
    names = [f"c{i}" for i in range(len(columns))]
    clean = lambda v: F.when(~F.isnan(v), v)
    some = rows.select(*[clean(F.col(c).cast("double")).alias(n) for c, n in zip(columns, names, strict=True)])
    facts = some.agg(*[x for n in names for x in (F.count(n).alias(f"n_{n}"), F.min(n).alias(f"min_{n}"), F.max(n).alias(f"max_{n}"))]).first()
    live = [n for n in names if facts[f"n_{n}"]]
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    if not live:
        return out
    brackets = {}
    for n in live:
        room = 2e-4 + 2 / facts[f"n_{n}"]
        brackets[n] = [max(0.0, p - room) for p in shares], [min(1.0, p + room) for p in shares]
    found = some.agg(*[F.percentile_approx(n, side, 20_000).alias(f"{k}_{n}") for n in live for k, side in zip(("low", "high"), brackets[n], strict=True)]).first()
    edges = {(n, i): (facts[f"min_{n}"] if brackets[n][0][i] == 0 else found[f"low_{n}"][i], facts[f"max_{n}"] if brackets[n][1][i] == 1 else found[f"high_{n}"][i]) for n in live for i in range(len(shares))}
    ranks = {(n, i): (math.floor(p * (facts[f"n_{n}"] - 1)), min(math.floor(p * (facts[f"n_{n}"] - 1)) + 1, facts[f"n_{n}"] - 1)) for n in live for i, p in enumerate(shares)}
    # a value in a bracket is a row of its own; of those below, a row of a partition's count
    place = {key: k for k, key in enumerate(edges)}
    marks = [F.when((F.col(n) >= a) & (F.col(n) <= b), F.struct(F.lit(place[n, i]).alias("k"), F.col(n).alias("v"))).when(F.col(n) < a, F.struct(F.lit(place[n, i]).alias("k"), F.lit(None).cast("double").alias("v"))) for (n, i), (a, b) in edges.items()]
    counts = some.select(F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).groupBy("m.k", "m.v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    told = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ranks.values()])
    marked = counts.withColumn("upto", upto).withColumn("r", F.get(told, F.col("k"))).where(F.col("v").isNotNull())
    ends = {r["k"]: (r["x"], r["y"]) for r in marked.groupBy("k").agg(F.min(F.when(F.col("upto") > F.col("r.x"), F.col("v"))).alias("x"), F.min(F.when(F.col("upto") > F.col("r.y"), F.col("v"))).alias("y")).collect()}
    for (n, i), k in place.items():
        x, y = ends[k]
        p = shares[i] * (facts[f"n_{n}"] - 1)
        out[columns[names.index(n)]][i] = x + ((y if y is not None else x) - x) * (p - ranks[n, i][0])
    return out


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact interpolated quantiles of one column."""
    return quantiles_of(rows, [column], shares)[column]


def impute_median(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the column's median."""
    found = quantiles_of(rows, columns, [0.5])
    return rows.fillna({c: v[0] for c, v in found.items() if v[0] is not None})


def moments(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a deviation of zero counts as 1."""
    found = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (found[f"m_{c}"] or 0.0, found[f"s_{c}"] or 1.0) for c in columns}


def standardise(rows: DataFrame, columns: list[str], by: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    by = by or moments(rows, columns)
    return rows.withColumns({c: (F.col(c) - by[c][0]) / by[c][1] for c in columns})


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with is_test: per label the ``share`` of rows with the least hashes, exact up to a million rows a label and within a millionth beyond."""
    hashed = rows.withColumn("_h", F.conv(F.left(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed))), F.lit(13)), 16, 10).cast("long"))
    cut = hashed.groupBy(label).agg(F.percentile_approx("_h", share, 1_000_000).alias("_cut"))
    return hashed.join(F.broadcast(cut), label).withColumn("is_test", F.col("_h") <= F.col("_cut")).drop("_h", "_cut")


def downsample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones every time: a sampling operator."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def amount_profile(rows: DataFrame, column: str) -> DataFrame:
    """Median, 90th percentile (interpolated) and population deviation, at least the mean or 1 if there is none."""
    spread = F.stddev_pop(column)
    median, p90 = quantiles(rows, column, [0.5, 0.9])
    return rows.agg(F.lit(median).cast("double").alias("median"), F.lit(p90).cast("double").alias("p90"), F.when(spread > 1e-9, spread).otherwise(F.greatest(F.avg(column), F.lit(1.0))).alias("spread"))


def with_profile(rows: DataFrame, profile: DataFrame, column: str = "Amount") -> DataFrame:
    """``rows`` with pdf_amount_zscore and pdf_above_pdf_p90: the amount against the one row of a profile of statements' amounts. Without the column, as they are."""
    if column not in rows.columns:
        return rows
    p = profile.first()  # one row
    if p is None or p["median"] is None:
        return rows
    return rows.withColumns({"pdf_amount_zscore": (F.col(column) - p["median"]) / p["spread"], "pdf_above_pdf_p90": (F.col(column) > p["p90"]).cast("double")})


def label_mean(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: rows, positives and their share."""
    return rows.agg(F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(label).alias("share"))


def best_by(rows: DataFrame, name: str, metric: str) -> DataFrame:
    """One row: the name with the greatest metric (of equal ones the least name) and that metric."""
    return rows.agg(F.min_by(name, F.struct(-F.col(metric), F.col(name).cast("string"))).alias(name), F.max(metric).alias(metric))


def classification_metrics(rows: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; 0 where a denominator is."""
    yes, said = F.col(label) == 1, F.col(predicted) == 1
    a = rows.groupBy(*(by or [])).agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn"))
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    a = a.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return a.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def thresholds(rows: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """A row per distinct score, descending: cumulative true and false positives.

    Rows are counted per score; running sums are taken within ranges of scores and shifted by the sums of the ranges above, of which
    the driver sees one row each. Unless ``buckets`` is given there is a range for every ``RANGE_ROWS`` distinct scores, 64 at least.
    """
    per = rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    if buckets is None:
        buckets = max(64, (per.agg(F.approx_count_distinct("score")).first()[0] or 0) // RANGE_ROWS)
    cuts = sorted(set(per.agg(F.percentile_approx("score", [i / buckets for i in range(1, buckets)], max(10_000, 10 * buckets))).first()[0] or []))
    per = per.withColumn("_b", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("score"))))
    sums = {r["_b"]: (r["p"], r["n"]) for r in per.groupBy("_b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()}
    above = [tuple(sum(sums.get(k, (0, 0))[i] for k in range(b + 1, len(cuts) + 1)) for i in (0, 1)) for b in range(len(cuts) + 1)]
    shift = lambda i: F.get(F.array(*[F.lit(x[i]) for x in above]).cast("array<bigint>"), F.col("_b"))
    order = Window.partitionBy("_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return per.select("score", (F.sum("pos").over(order) + shift(0)).alias("tp"), (F.sum("neg").over(order) + shift(1)).alias("fp"), "pos", "neg")


def curves(rows: DataFrame, label: str, score: str) -> DataFrame:
    """score, true and false positive rate, precision: the points of the ROC and precision-recall curves."""
    t = thresholds(rows, label, score)
    p, n = t.agg(F.sum("pos"), F.sum("neg")).first()
    rate = lambda c, total: F.col(c) / F.lit(total) if total else F.lit(None).cast("double")
    return t.select("score", rate("tp", p).alias("tpr"), rate("fp", n).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def areas(rows: DataFrame, label: str, score: str) -> DataFrame:
    """roc_auc (ties count half) and average_precision; null if there is one class only."""
    t = thresholds(rows, label, score)
    p, n = F.sum("pos"), F.sum("neg")
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (p * n)
    return t.agg(F.when((p > 0) & (n > 0), auc).alias("roc_auc"), F.when((p > 0) & (n > 0), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / p).alias("average_precision"))


def histogram(rows: DataFrame, column: str, bins: int = 80) -> DataFrame:
    """bin, count and density over the range of the column."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return rows.sparkSession.createDataFrame([], "bin int, count bigint, density double")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counted = rows.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    total = rows.where(F.col(column).isNotNull()).count()
    return counted.withColumn("density", F.col("count") / (total * width))


def business_score(recall: Column, precision: Column, auc: Column, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    """Weighted metrics; negative weights count as 0 and the rest add up to 1."""
    kept = [max(w, 0.0) for w in weights]
    kept = [w / sum(kept) for w in kept] if sum(kept) > 0 else [0.6, 0.3, 0.1]
    return recall * kept[0] + precision * kept[1] + F.coalesce(auc, F.lit(0.0)) * kept[2]


def path_length(n: float) -> float:
    """Mean depth of a search that ends unfound in a tree of n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def isolation_trees(rows: DataFrame, columns: list[str], key: str, trees: int = 200, sample: int = 256, seed: int = 42) -> list[dict]:
    """An isolation forest: each tree is grown in its own task from its sample of at most ``sample`` rows.

    Rows take part in a tree if the hash of their ``key`` is below twice the sample's share of all, so that rows of equal values are drawn like
    others; only the trees, of bounded size, reach the driver.
    """
    total = rows.count()
    if not total:
        return []
    share = min(1.0, 2.0 * sample / total)
    values = rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.xxhash64(key).alias("_r"))
    part = lambda t: F.when(F.pmod(F.xxhash64("_r", t, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)), t.cast("int"))
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), part), lambda t: t.isNotNull())
    dealt = values.select("x", "_r", F.explode(drawn).alias("tree")).withColumn("_h", F.xxhash64("_r", "tree", F.lit(seed)))

    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        tree = int(batch["tree"].iloc[0])
        x = np.stack(batch.sort_values("_h")["x"].head(sample).to_numpy())
        random = np.random.default_rng(seed + tree)
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes: list[tuple] = []

        def build(part: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append(())
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
            if depth >= limit or not len(spread):
                nodes[me] = (-1, 0.0, -1, -1, float(depth + path_length(len(part))))
                return me
            f = int(random.choice(spread))
            cut = float(random.uniform(part[:, f].min(), part[:, f].max()))
            left = part[:, f] < cut
            a = build(part[left], depth + 1)
            nodes[me] = (f, cut, a, build(part[~left], depth + 1), 0.0)
            return me

        build(x, 0)
        c = list(zip(*nodes, strict=True))
        return pd.DataFrame({"tree": [tree], "n": [len(x)], "feature": [list(c[0])], "cut": [list(c[1])], "low": [list(c[2])], "high": [list(c[3])], "depth": [list(c[4])]})

    found = dealt.groupBy("tree").applyInPandas(grow, "tree int, n int, feature array<int>, cut array<double>, low array<int>, high array<int>, depth array<double>")
    return [r.asDict() for r in sorted(found.collect(), key=lambda r: r["tree"])]


def anomaly_score(forest: list[dict], columns: list[str] | Column, spark) -> Column:
    """2^(-mean depth / expected depth) of a row's columns, or array, above 0.5 for what is isolated early."""
    shared = spark.sparkContext.broadcast([({k: np.array(t[k]) for k in ("feature", "cut", "low", "high", "depth")}, t["n"]) for t in forest])

    @F.pandas_udf("double")
    def scored(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = shared.value
        scale = np.mean([path_length(n) for _, n in trees]) or 1.0
        for batch in x:
            if not len(batch):
                yield pd.Series([], dtype="float64")
                continue
            m = np.stack(batch.to_numpy()).astype(float)
            total = np.zeros(len(m))
            for t, _ in trees:
                at = np.zeros(len(m), int)
                while (inner := t["feature"][at] >= 0).any():
                    f = np.maximum(t["feature"][at], 0)
                    step = np.where(m[np.arange(len(m)), f] < t["cut"][at], t["low"][at], t["high"][at])
                    at = np.where(inner, step, at)
                total += t["depth"][at]
            yield pd.Series(2.0 ** (-(total / len(trees)) / scale))

    return scored(columns if isinstance(columns, Column) else F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]))


def outliers(scored: DataFrame, contamination: float = 0.05) -> DataFrame:
    """``scored`` with is_outlier: anomaly_score above its 1 - contamination quantile."""
    cut = scored.agg(F.percentile_approx("anomaly_score", 1 - contamination, 100_000)).first()[0]
    return scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(cut))
