"""Dataflow queries against DuckDB; run metrics, subtotals, request checks and SQL functions on small fixtures."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.dataflows import ORACLE_SQL, QUERIES
from ledgerlens.functions import metrics
from ledgerlens.operators import explain, history, requests, scoring
from ledgerlens.operators.features import features
from ledgerlens.plans import sql_surface


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in "customer part orders lineitem events documents embeddings pages labels conversations".split():
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(frame.columns)
    order = [found.columns.index(c) for c in frame.columns]
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_run_metrics(spark):
    run = metrics.Run("r")
    rows = run.step(spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, None)], "x int, y string"), "in", nulls=["x", "y"])
    rows = run.step(rows.where("x > 1"), "some", largest=F.max("x"))
    run.timed("all", lambda: run.step(rows.where("x > 5"), "none", nulls=["y"]).collect())
    told = {(s, k): v for _, s, k, v in run.rows()}
    assert told.pop(("all", "seconds")) > 0
    assert told == {("in", "rows"): 4, ("in", "null_share_x"): 0.25, ("in", "null_share_y"): 0.5, ("some", "rows"): 2, ("some", "largest"): 3, ("none", "rows"): 0, ("none", "null_share_y"): 0}
    assert sorted(map(tuple, metrics.dropped(run.frame(spark), ["in", "some", "none"]).collect())) == [("r", "none", 2), ("r", "some", 2)]
    with pytest.raises(ValueError, match="already"):
        run.step(rows, "in")


def test_stream_log(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 5 + i).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    log = metrics.StreamLog(spark, f"file://{tmp_path}/log", {"watched"})
    spark.streams.addListener(log)
    try:
        for name in ("watched", "other"):
            rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in").observe("step", F.count(F.lit(1)).alias("rows"), F.max("id").alias("most"))
            rows.writeStream.queryName(name).format("noop").option("checkpointLocation", f"file://{tmp_path}/c-{name}").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):  # listeners are told later
            try:
                told = {(r["run"], r["step"], r["metric"]): r["value"] for r in spark.read.parquet(f"file://{tmp_path}/log").collect()}
                if ("watched:2", "step", "most") in told:
                    break
            except Exception:  # nothing is there yet
                pass
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert sorted(told[f"watched:{b}", "step", "rows"] for b in range(3)) == sorted(told[f"watched:{b}", "batch", "rows"] for b in range(3)) == [5, 6, 7]
    assert not any(run.startswith("other") for run, _, _ in told) and max(told[f"watched:{b}", "step", "most"] for b in range(3)) == 26


def test_subtotals_tell_null_keys_from_sums(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 2), (None, None, 5)], "k string, l string, v int")
    found = {(r["k"], r["l"], r["level"]): (r["n"], r["sum"], r["different"]) for r in history.subtotals(rows, ["k", "l"], {"n": F.count("*"), "sum": F.sum("v"), "different": F.countDistinct("v")}).collect()}
    assert found == {("a", None, 2): (1, 1, 1), ("a", "x", 2): (1, 2, 1), (None, "x", 2): (1, 2, 1), (None, None, 2): (1, 5, 1), ("a", None, 1): (2, 3, 2), (None, None, 1): (2, 7, 2), (None, None, 0): (4, 10, 3)}
    assert history.subtotals(rows.limit(0), ["k"], {"n": F.count("*")}).where("level = 1").count() == 0


def test_requests(spark):
    rows = spark.createDataFrame([(1, "what", "d-1", "5"), (2, "  \n", None, "x"), (3, "ab", "d/1", "51"), (4, None, "", None), (5, "x" * 11, "d", "nan")], "i int, query string, document string, k string")
    found = requests.validated(rows, ["query", "document"], {"query": (3, 10)}, {"k": (1, 50)}, {"document": "^[a-z0-9-]+$"})
    told = {r["i"]: (r["status"], [e["field"] for e in r["errors"]]) for r in found.collect()}
    assert told == {1: (200, []), 2: (400, ["query", "document", "k"]), 3: (400, ["query", "k", "document"]), 4: (400, ["query", "document"]), 5: (400, ["query", "k"])}
    assert requests.accepted(found).columns == rows.columns and requests.accepted(found).count() == 1


def test_sql_functions_equal_expressions(spark, sf):
    sql_surface.functions(spark)
    rows = spark.range(400).select((F.col("id") * 0.37 - 20).alias("s"), (F.col("id") % 11 / 10).alias("r"), (F.col("id") % 3 == 0).alias("f"))
    rows.createOrReplaceTempView("cases")
    for kind in scoring.BANDS:
        assert spark.sql(f"SELECT s, risk_band(s, '{kind}') AS b FROM cases").exceptAll(rows.select("s", scoring.band(F.col("s"), kind).alias("b"))).count() == 0
    mine = spark.sql("SELECT s, r, f, combined_score(s, r) AS c, hybrid_fraud(s, r, f) AS h, hybrid_level(s, r) AS l, calibrated_risk(r) AS a, calibrated_risk(r, 0.5D) AS b, risk_verdict_text(s, f) AS t, risk_recommendation(s, f) AS g FROM cases")
    v = scoring.verdict(F.col("s"), F.col("r"), F.col("f"))
    want = rows.select("s", "r", "f", scoring.combined_score(F.col("s"), F.col("r")).alias("c"), v["is_fraud"].alias("h"), v["risk_level"].alias("l"), scoring.calibrated(F.col("r")).alias("a"), scoring.calibrated(F.col("r"), 0.5).alias("b"), explain.verdict_text(F.col("s"), F.col("f")).alias("t"), explain.recommendation(F.col("s"), F.col("f")).alias("g"))
    assert mine.exceptAll(want).count() == 0 and mine.count() == 400
    some = features(spark.createDataFrame([("s", i, None, float(i * 900), "debit", "Casino") for i in range(9)] + [("t", 0, None, None, None, None)], "statement_id string, seq long, date string, amount double, type string, merchant string"))
    some.createOrReplaceTempView("some_features")
    got = spark.sql(f"SELECT statement_id, rule_score({', '.join(sql_surface.RULE_INPUTS)}) AS x FROM some_features")
    assert got.exceptAll(some.select("statement_id", scoring.rule_score().alias("x"))).count() == 0


def test_search_from_sql(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("label AS document_id", "vec_id AS chunk_id", "embedding AS vector")
    sql_surface.register(spark, chunks=rows)
    got = [(r["chunk_id"], r["rank"]) for r in spark.sql("SELECT * FROM nearest_chunks((SELECT vector FROM chunk_vectors WHERE chunk_id = 7), 5) ORDER BY rank").collect()]
    vectors = {r["chunk_id"]: r["vector"] for r in rows.collect()}
    near = sorted(vectors, key=lambda i: sum((a / sum(x * x for x in vectors[i]) ** 0.5 - b / sum(x * x for x in vectors[7]) ** 0.5) ** 2 for a, b in zip(vectors[i], vectors[7], strict=True)))[:5]
    assert got == [(str(i), k) for k, i in enumerate(near, 1)]


def test_language_client(spark):
    from ledgerlens.operators import answers, language

    calls = spark.sparkContext.accumulator(0)

    def client(prompts, system):
        calls.add(1)
        if any("fail" in p for p in prompts):
            raise ConnectionError("away")
        return [""] * len(prompts) if system == "mute" else [f"{system}: {p} " for p in prompts]

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "fail", None, "b", "c", "fail", "d"])], "query_id int, prompt string").coalesce(1)
    found = {r["query_id"]: r["answer_text"] for r in language.answered(rows, client, "s").collect()}
    assert found == {0: "s: a", 1: None, 2: None, 3: "s: b", 4: "s: c", 5: None, 6: "s: d"}
    told = rows.select(language.completed(F.col("prompt"), client, "s", lot=2).alias("x")).select("x.text", "x.error").collect()
    assert [bool(r["error"]) for r in told] == [False, True, False, False, False, True, False] and "ConnectionError: away" in told[1]["error"]
    assert {r["answer_text"] for r in language.answered(rows, client, "mute").collect()} == {None} == {r["answer_text"] for r in language.answered(rows, None, "s").collect()}
    short = rows.select(language.completed(F.col("prompt"), lambda p, s: ["x"] if len(p) == 1 else ["x"] * (len(p) + 1), "s").alias("x"))
    assert [r["x"]["text"] for r in short.collect()] == ["x", "x", None, "x", "x", "x", "x"]
    before = calls.value
    language.answered(rows.where("query_id = 0"), client, "s").select("answer_text", F.length("answer_text").alias("n")).collect()
    assert calls.value == before + 1  # a row is asked once
    ranked = spark.createDataFrame([(0, 1, "c1", 3, "Risk", 0.5)], "query_id int, rank int, chunk_id string, page_number int, section_title string, final_score double")
    out = answers.responses(language.answered(rows.withColumn("query", F.lit("q")), client, "**Answer:** x"), ranked)
    assert {r["query_id"]: r["answer"] for r in out.collect()}[1] == answers.NOT_FOUND
