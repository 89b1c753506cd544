"""How often the parser of statement text looks at a line, and the white space that it splits at."""

from ledgerlens import dataflows
from ledgerlens.functions import tables
from ledgerlens.operators import transactions as tx
from ledgerlens.plans import risk

BLANKS = "\t\x1f       　 "
ENDS = ["\n", "\r\n", "\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "\n\r", "\r\r\n"]


def test_line_is_searched_once(spark):
    rows = spark.createDataFrame([("s", "05 Jan 2025 POS 5.00 x")], "statement_id string, text string")
    plan = tx.parse(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|") == 1  # a filter on what the pattern finds would find it again
    assert plan.count("regexp_extract_all(rest") == 2 and "gettimestamp" not in plan
    assert "split(" in plan and r"\x{2028}\x{2029}\x{1c}-\x{1e}], -1)" not in plan  # a pattern would be compiled for each text


def test_white_space(spark):
    texts = [f"a{b}{c} {e} b{c}{e}{b}{e}c {b}" for b in BLANKS for c in ("", " ", "\t") for e in ENDS] + ["a᠎b​c", "\x1f", "\r", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "statement_id int, text string")
    found = sorted(map(tuple, tx.lines(rows).collect()))
    assert found == [(i, n, " ".join(x.split())) for i, t in enumerate(texts) for n, x in enumerate((t or "").splitlines()) if x.split()]


def test_amount_that_begins_in_the_date(spark):
    lines = ["Jan 5, 2025,000 7.00 x", "01/02/20251234 50 CR y", "2025-01-0512.50 3.00 z", "1/2/2025.75 dr 12 DR w", "1/2/2025CR 8 312 12 v", "5 Jan 2025 312 12 312 u"]
    rows = spark.createDataFrame([("s", "\n".join(lines))], "statement_id string, text string")
    told = {r["seq"]: (r["date"], r["amount"], r["type"], r["merchant"]) for r in tx.parse(rows).collect()}
    assert told == {i: x for i, line in enumerate(lines) if (x := tables.transaction(line))} and len(told) == len(lines)


def test_written_day_is_tried_once(monkeypatch):
    tried, real = [], tables.datetime
    monkeypatch.setattr(tables, "datetime", type("Told", (), {"strptime": staticmethod(lambda raw, form: tried.append(raw) or real.strptime(raw, form))}))
    found = {tables.transaction(f"1987-03-0{i % 2 + 1} POS {i}.50 x")[0] for i in range(100)}
    assert found == {"1987-03-01", "1987-03-02"} and len(tried) <= 2 * len(tables.FORMATS)


def test_report_parses_once(spark, monkeypatch, sf):
    plans, real = [], risk.analyse
    monkeypatch.setattr(risk, "analyse", lambda rows, *more: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or real(rows, *more))
    report = dataflows.statement_report(spark, sf)
    assert len(plans) == 1 and "regexp" not in plans[0].lower() and report.count() > 100
    assert "regexp_extract_all" not in report._jdf.queryExecution().optimizedPlan().toString()
