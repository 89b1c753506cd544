"""The take-over pattern as a stateful stream: a credit, then cash-outs, per account.

Each account keeps what the batch operator counts (transactions, whether a credit has been, what came after it, cash-outs and moves
among the later debits) as one value, the last three later debits as a list, and the transactions that may still be overtaken by
earlier ones, in event time, as another list. A timer at an account's latest transaction settles those when the watermark has passed them; a
second one, ``idle`` after it, drops the account's state. Whenever transactions come, the score that the settled and the waiting ones
give together, in order of time and seq, is told, so that alerts don't wait for the watermark and the last row of an account is
the batch operator's.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.functions import merchants as m

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECENT = 3
COUNTS = ["n", "rest", "outs", "moves"]
PENDING = "at long, seq long, kind int, moved boolean, out boolean"
OTHER, CREDIT, DEBIT = 0, 1, 2


def score(counts: dict, recent: list[bool]) -> float:
    """Least counts of the pattern's three grades."""
    if counts["n"] < 4 or counts["rest"] < 3:
        return 0.0
    hits = sum(recent)
    if counts["moves"] >= 2 and hits >= 2:
        return 90.0
    if counts["outs"] >= 2 and hits >= 2:
        return 75.0
    return 60.0 if counts["outs"] >= 1 and hits >= 1 and counts["moves"] >= 1 else 0.0


def advanced(counts: dict, recent: list[bool], kind: int, moved: bool, out: bool) -> tuple[dict, list[bool]]:
    """Counts and last debits after one more transaction."""
    now = counts | {"n": counts["n"] + 1}
    if not counts["credited"]:
        return now | {"credited": kind == CREDIT}, recent
    now["rest"] += 1
    if kind != DEBIT:
        return now, recent
    return now | {"outs": now["outs"] + out, "moves": now["moves"] + moved}, [*recent, out][-RECENT:]


class TakeoverDetector(StatefulProcessor):
    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PENDING)
        self.counts = handle.getValueState("counts", "credited boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", latest long")
        self.recent = handle.getListState("recent", "out boolean")

    def settled(self) -> tuple[dict, list[bool]]:
        counts = self.counts.get()
        if counts is None:
            return {"credited": False, **dict.fromkeys(COUNTS, 0), "latest": 0}, []
        return dict(zip(["credited", *COUNTS, "latest"], counts, strict=True)), [bool(r[0]) for r in self.recent.get()]

    def keep(self, counts: dict, recent: list[bool]) -> None:
        self.counts.update(tuple(counts[c] for c in ["credited", *COUNTS, "latest"]))
        if recent:
            self.recent.put([(x,) for x in recent])

    def held(self) -> dict[tuple[int, int], tuple[int, bool, bool]]:
        return {(r[0], r[1]): (r[2], r[3], r[4]) for r in self.waiting.get()}

    def hold(self, rows: dict[tuple[int, int], tuple[int, bool, bool]]) -> None:
        if rows:
            self.waiting.put([(*k, *v) for k, v in rows.items()])
        else:
            self.waiting.clear()

    def settle(self, watermark: int) -> None:
        """Count what waits up to the watermark, in order."""
        counts, recent = self.settled()
        rest = self.held()
        for k in sorted(k for k in rest if k[0] <= watermark * 1000 + 999):
            counts, recent = advanced(counts, recent, *rest.pop(k))
        self.hold(rest)
        self.keep(counts, recent)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        counts, recent = self.settled()
        waiting = self.held() | {(r["_at"], r["seq"]): (r["_kind"], r["_moved"], r["_out"]) for r in rows}
        self.hold(waiting)
        latest = max(counts["latest"], max(waiting)[0])
        if latest > counts["latest"]:
            if counts["latest"]:
                self.handle.deleteTimer(counts["latest"] // 1000 + self.idle_ms)
            self.handle.registerTimer(latest // 1000)
            self.handle.registerTimer(latest // 1000 + self.idle_ms)
            self.keep(counts | {"latest": latest}, recent)
        for _, value in sorted(waiting.items()):
            counts, recent = advanced(counts, recent, *value)
        moment = datetime.fromtimestamp(latest // 1_000_000, UTC).replace(microsecond=latest % 1_000_000)
        yield Row(**{self.key: key[0], "takeover_score": score(counts, recent), "transactions": counts["n"], "latest": moment})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        counts, _ = self.settled()
        if expiredTimerInfo.getExpiryTimeInMs() >= counts["latest"] // 1000 + self.idle_ms:
            self.waiting.clear()
            self.counts.clear()
            self.recent.clear()
        else:
            self.settle(timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def marked(transactions: DataFrame, key: str, time: str, late: str) -> DataFrame:
    kind = F.lower(F.coalesce("type", F.lit("")))
    described = F.coalesce("description", F.lit("")) if "description" in transactions.columns else F.lit("")
    text = F.concat_ws(" ", described, F.coalesce("merchant", F.lit("")))
    moment = F.col(time).cast("timestamp")
    rows = transactions.select(
        F.col(key), moment.alias("_time"), F.unix_micros(moment).alias("_at"), F.col("seq").cast("long").alias("seq"), F.when(kind == "credit", CREDIT).when(kind == "debit", DEBIT).otherwise(OTHER).alias("_kind"),
        m.contains_any(text, m.TRANSFERS).alias("_moved"), m.contains_any(text, m.CASH_OUT).alias("_out"),
    )
    return rows.where(F.col(key).isNotNull() & F.col("_at").isNotNull() & F.col("seq").isNotNull()).withWatermark("_time", late)


def takeover_stream(transactions: DataFrame, key: str = "statement_id", time: str = "ts", late: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """(key, takeover_score, transactions, latest) whenever an account has new transactions; the newest row of each is its state.

    ``transactions`` (key, seq, type, merchant, ``time``, and description if there is one) come in any order within ``late``; those that come
    later than the watermark are dropped, as are rows without key, time or seq. Rows of equal time and seq are one. Accounts
    without transactions for ``idle`` are forgotten. The stream's checkpoint and the RocksDB state store (``ROCKS``) are the caller's to set.
    """
    rows = marked(transactions, key, time, late)
    kind = rows.schema[key].dataType.simpleString()
    interval = rows.sparkSession.range(1).select((F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {idle})"))).first()[0]
    return rows.groupBy(key).transformWithState(TakeoverDetector(key, interval), f"{key} {kind}, takeover_score double, transactions long, latest timestamp", "Update", "EventTime")
