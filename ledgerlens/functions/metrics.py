"""What a run has done: rows in and kept, rows dropped by reason, shares of nulls, and seconds, observed while the run goes on.

Batches are observed by ``DataFrame.observe`` between their steps, so that counting needs no pass of its own; streams report the same
names batch by batch to a listener. Both give rows (run, step, metric, value) that are appended to one table.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run string, step string, metric string, value double"


def null_share(column: str) -> Column:
    return F.coalesce(F.avg(F.col(column).isNull().cast("int")), F.lit(0.0))


class Run:
    """Steps of one run, observed as their rows go by; ``rows`` after its action."""

    def __init__(self, name: str):
        self.name = name
        self.steps: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def step(self, rows: DataFrame, name: str, nulls: tuple[str, ...] | list[str] = (), **more: Column) -> DataFrame:
        """``rows``, counted under ``name`` with the share of nulls in some columns and ``more`` aggregates."""
        if name in self.steps:
            raise ValueError(f"{name} is observed already")
        self.steps[name] = Observation(f"{self.name}:{name}")
        return rows.observe(self.steps[name], F.count(F.lit(1)).alias("rows"), *[null_share(c).alias(f"null_share_{c}") for c in nulls], *[c.alias(k) for k, c in more.items()])

    def timed(self, name: str, action: Callable[[], object]) -> object:
        """What ``action`` gives, and how long it took as metric seconds of ``name``."""
        began = time.perf_counter()
        try:
            return action()
        finally:
            self.seconds[name] = time.perf_counter() - began

    def rows(self) -> list[tuple[str, str, str, float]]:
        """(run, step, metric, value) of all steps whose action has been."""
        told = [(self.name, step, k, None if v is None else float(v)) for step, o in self.steps.items() for k, v in o.get.items()]
        return told + [(self.name, step, "seconds", s) for step, s in self.seconds.items()]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), SCHEMA)


def dropped(run: DataFrame, steps: list[str]) -> DataFrame:
    """(run, step, dropped): rows that each of ``steps``, in order, has lost since the one before."""
    counts = run.where(F.col("metric") == "rows").select("run", "step", F.col("value").cast("long").alias("n"))
    order = F.array_position(F.array(*map(F.lit, steps)), F.col("step"))
    named = counts.where(order > 0).groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("i"), "step", "n"))), lambda s: s).alias("s"))
    lost = F.transform(F.sequence(F.lit(2), F.size("s")), lambda i: F.struct(F.element_at("s", i)["step"].alias("step"), (F.element_at("s", i - 1)["n"] - F.element_at("s", i)["n"]).alias("dropped")))
    return named.where(F.size("s") > 1).select("run", F.inline(lost))


class StreamLog(StreamingQueryListener):
    """Appends what every batch of the session's named streams has done to a table: rows, seconds, the watermark, and observed metrics."""

    def __init__(self, spark: SparkSession, path: str, names: set[str] | None = None):
        self.spark, self.path, self.names = spark, path, names

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if self.names is not None and p.name not in self.names:
            return
        run = f"{p.name or p.id}:{p.batchId}"
        told = [(run, "batch", "rows", float(p.numInputRows)), (run, "batch", "seconds", (p.durationMs or {}).get("triggerExecution", 0) / 1000)]
        for operator in p.stateOperators:
            told += [(run, operator.operatorName, "state_rows", float(operator.numRowsTotal)), (run, operator.operatorName, "late_rows", float(operator.numRowsDroppedByWatermark))]
        for step, row in (p.observedMetrics or {}).items():
            told += [(run, step, k, None if v is None else float(v)) for k, v in row.asDict().items()]
        self.spark.createDataFrame(told, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
