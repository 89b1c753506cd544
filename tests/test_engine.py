"""The engine's queries against DuckDB, and its operators on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import merchants as m
from ledgerlens.functions import text as t
from ledgerlens.functions.dates import normalised_date, tidied
from ledgerlens.operators import answers, documents, evaluation, explain, history, learning, prediction, retrieval, scoring
from ledgerlens.operators.features import FEATURES, features, vector
from ledgerlens.operators.transactions import parse
from ledgerlens.plans import training
from ledgerlens.plans.risk import analyse
from ledgerlens.queries import ORACLE_SQL, QUERIES
from ledgerlens.sources import readers
from ledgerlens.streaming.velocity import velocity

TX = "statement_id string, seq long, date string, amount double, type string, merchant string"


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
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


def statement(spark, rows, dated=False):
    return spark.createDataFrame([("s", i, f"2026-01-{i + 1:02d}" if dated else None, float(a), k, x) for i, (a, k, x) in enumerate(rows)], TX)


def test_basic_features(spark):
    rows = [(50000, "credit", "Salary Deposit"), (5000, "debit", "GroceryMart"), (2000, "debit", "Pharmacy"), (8000, "debit", "Netflix"), (500, "debit", "Coffee Shop")]
    f = features(statement(spark, rows)).first().asDict()
    assert list(f)[1:] == FEATURES and len(FEATURES) == 30
    want = {"total_transactions": 5, "total_credits": 1, "total_debits": 4, "legitimate_merchants": 4, "avg_transaction_amount": 13100, "median_transaction": 5000, "high_value_transactions": 2, "large_debit_transactions": 1, "avg_txn_per_day": 5, "debit_credit_ratio": 4, "max_to_median_ratio": 10}
    assert {k: f[k] for k in want} == want
    assert f["transaction_std_dev"] == pytest.approx(20827.865951) and f["amount_spike_ratio"] == pytest.approx(3.816794) and f["debit_amount_share"] == pytest.approx(15500 / 65500)


def test_high_risk_statement(spark):
    rows = [(45000, "debit", "CasinoXYZ"), (12000, "debit", "Gambling House"), (5000, "debit", "Crypto Exchange"), (50000, "credit", "Employer Salary")]
    r = features(statement(spark, rows)).withColumn("score", scoring.rule_score()).first()
    assert r["high_risk_merchants"] == 2 and r["high_risk_merchant_ratio"] == 0.75 and r["score"] == pytest.approx(74.52888862)


def test_takeover_statement(spark):
    rows = [(7000, "credit", "Salary"), (200, "debit", "Normal Spend"), (200, "debit", "Normal Spend"), (200, "debit", "Normal Spend"), (2000, "debit", "ATM Withdrawal"), (2500, "debit", "Unknown Transfer"), (1800, "debit", "Wire Transfer Intl")]
    r = analyse(statement(spark, rows, dated=True)).first()
    assert r["takeover_score"] == 90 and r["is_fraud"] and r["risk_level"] == "HIGH" and any("account takeover" in x for x in r["reasons"])
    assert (r["rapid_same_merchant_transactions"], r["cash_like_activity"], r["high_risk_merchants"], r["large_debit_transactions"]) == (2, 3, 2, 3)
    assert r["max_amount_zscore"] == pytest.approx(2.075857, abs=1e-6) and r["rule_score"] == pytest.approx(52.67012395)


def test_single_casino_and_empty_statement(spark):
    every = spark.createDataFrame([("s",), ("none",)], "statement_id string")
    rows = {r["statement_id"]: r for r in features(statement(spark, [(50000, "debit", "CASINO")]), statements=every).withColumn("score", scoring.rule_score()).collect()}
    assert rows["s"]["score"] == 85 and all(rows["none"][f] == 0 for f in FEATURES)


def test_nulls_and_ties_in_transactions(spark):
    rows = spark.createDataFrame([("s", 0, None, None, None, None), ("s", 1, "nonsense", 0.0, "DEBIT", ""), ("s", 2, "2026-01-01", 5.0, "Debit", None), ("s", 2, "2026-01-01", 5.0, "Debit", None)], TX)
    r = analyse(rows).first()
    assert r["total_transactions"] == 4 and r["total_debits"] == 3 and r["avg_txn_per_day"] == 4 and r["max_transaction"] == 5
    assert analyse(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("rule", "risk", "flag", "want"), [(30.0, 0.63, False, (56.4, True, "medium")), (6.0, 0.18, False, (15.6, False, "low")), (80.0, 0.0, False, (16.0, True, "high")), (20.0, 0.0, True, (4.0, True, "low"))])
def test_hybrid_verdict(spark, rule, risk, flag, want):
    v = spark.range(1).select(scoring.verdict(F.lit(rule), F.lit(risk), F.lit(flag)).alias("v")).first()["v"]
    assert (v["combined_score"], v["is_fraud"], v["risk_level"]) == want


LINES = {
    "05 Jan 2025 POS Debit ₹45000 CasinoXYZ": ("2025-01-05", 45000.0, "debit", "CasinoXYZ"),
    "06 Jan 2025 UPI DR INR 1200 GroceryMart": ("2025-01-06", 1200.0, "debit", "GroceryMart"),
    "07/01/2025 Salary Credit ₹85000 ACME_PAYROLL": ("2025-01-07", 85000.0, "credit", "ACME_PAYROLL"),
    "2025-01-08 IMPS CR 3500 RefundFromMerchant": ("2025-01-08", 3500.0, "credit", "RefundFromMerchant"),
    "Statement period: 01 Jan 2025 to 31 Jan 2025": None,
    "Opening Balance: ₹120000": None,
    "Thank you for banking with us.": None,
    "01-02-2026 NEFT INTEREST CREDIT 919919523 1200.00 53200.00": ("2026-02-01", 1200.0, "credit", "INTEREST"),
    "01-02-2026 UPI/FLIPKART/online 489156581 1425.73 51774.27": ("2026-02-01", 1425.73, "debit", "UPI/FLIPKART/online"),
    "22-02-2026 CRYPTO EXCHANGE PURCHASE 118855823 3602.46 10500.72": ("2026-02-22", 3602.46, "debit", "CRYPTO EXCHANGE PURCHASE"),
    "23-02-2026 SALARY CREDIT TECHCORP PVT LTD 751486575 1200.00 65419.73": ("2026-02-23", 1200.0, "credit", "SALARY TECHCORP PVT LTD"),
}


def test_statement_lines(spark):
    rows = spark.createDataFrame([("s", "\n".join(LINES)), ("empty", ""), ("null", None)], "statement_id string, text string")
    found = {r["seq"]: (r["date"], r["amount"], r["type"], r["merchant"]) for r in parse(rows).collect()}
    assert found == {i: v for i, v in enumerate(LINES.values()) if v}


@pytest.mark.parametrize(("raw", "want"), [("05 January 2025", "2025-01-05"), ("Jan 5, 2025", "2025-01-05"), ("5/1/70", "1970-01-05"), ("5/1/68", "2068-01-05"), ("31/02/2025", None), ("5-1/2025", None), ("JAN 05 2025", "2025-01-05")])
def test_dates(spark, raw, want):
    assert spark.range(1).select(normalised_date(tidied(F.lit(raw))).alias("d")).first()["d"] == want


def test_merchant_predicates(spark):
    row = lambda f, name: spark.range(1).select(f(F.lit(name)).alias("x")).first()["x"]
    assert [row(m.is_high_risk, x) for x in ("CasinoXYZ", "Casino Royal", "Bitcoin Exchange", "Barnes", "batman")] == [True, True, False, True, False]
    assert row(m.is_sensitive, "Bitcoin Exchange") and row(m.is_cash_like, "batman") and all(row(m.is_legitimate, x) for x in ("Salary", "GroceryMart", "Hospital"))
    assert row(m.category_labels, "Lucky Casino crypto Bitcoin") == ["Casinos", "Cryptocurrency exchanges"]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(t.format_amount(F.lit(x))) for x in (50.25, 1500.0, 150000.0)] == ["$50.25", "$1,500", "$150K"]
    assert one(t.mask_sensitive(F.lit("1234567890 12345 ABCDE1234F"))) == "******7890 12345 XXXXX1234X"
    assert one(t.clean(F.lit("ﬁne \t text\r\n\r\n x "))) == "fine text\nx"
    assert one(explain.report_id(F.lit("doc1.pdf"), F.lit("20260101"))) == "RISK_REPORT_doc1pdf_20260101"
    assert one(documents.compliance_band(F.lit(6), F.lit(0))) == "high"
    assert [one(explain.recommendation(F.lit(s), F.lit(f)))[:6] for s, f in ((78.5, True), (55.0, True), (25.0, False))] == ["URGENT", "Manual", "No act"]
    assert one(explain.normalised_recommendation(F.lit("URGENT now"), F.lit(50.0), F.lit(False))).startswith("Enhanced")
    assert one(explain.summary_line(F.lit("HIGH"), F.lit(78.5), F.lit("urgent.pdf"), F.array(*map(F.lit, "abcd")))) == "HIGH | 78.5/100 | urgent.pdf | a; b; c (+1 more)"


def test_chunks(spark):
    body = "Alpha one. Beta two. Gamma three.\n\n# Title\nDelta four."
    rows = retrieval.chunk_documents(spark.createDataFrame([("d", body), ("n", None)], "document_id string, text string"), size=5, overlap=2).orderBy("position").collect()
    assert [r["content"] for r in rows] == ["Alpha one. Beta two.", " two.\n\nGamma three.", " three.\n\n# Title\nDelta four."]
    assert rows[0]["chunk_id"] == "d_chunk_0000" and rows[0]["page_number"] == 1 and rows[1]["page_number"] is None


def test_index_and_cache(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "document_id string, content string")
    readers.write_index(chunks, str(tmp_path / "index"))
    readers.write_index(spark.createDataFrame([("a", "z")], "document_id string, content string"), str(tmp_path / "index"))
    assert {tuple(sorted(r.asDict().items())) for r in readers.read_index(spark, str(tmp_path / "index")).collect()} == {(("content", "z"), ("document_id", "a")), (("content", "y"), ("document_id", "b"))}
    assert readers.read_index(spark, str(tmp_path / "index"), "a").count() == 1


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date, AMOUNT ,Type,Description\n2026-01-01,5.5,Debit,Shop\n2026-01-02,x,debit,Bad\n2026-01-03,7,other,Bad\n2026-01-04,1\n")
    rows = readers.transactions_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["amount"], r["type"], r["merchant"]) for r in rows] == [(5.5, "debit", "Shop")]
    (tmp_path / "b.csv").write_text("Time,V1,Amount,Class,name\n0,1.5,10,0,a\n1,,20,1,b\n")
    labelled = readers.training_csv(spark, str(tmp_path / "b.csv"))
    assert labelled.columns == ["Time", "V1", "Amount", "label"] and learning.impute_median(labelled, ["V1"]).where("V1 = 1.5").count() == 2
    cards = readers.card_transactions(spark.read.csv(str(tmp_path / "b.csv"), header=True, inferSchema=True), "Time")
    assert features(cards).count() == 2
    (tmp_path / "x.PDF").write_bytes(b"%PDF-1.4 page")
    files = readers.files(spark, str(tmp_path / "x.PDF"))
    assert files.first()["is_pdf"] and readers.document_text(readers.pages(files, lambda b: [" one ", "", "two"])).first()["text"] == "one\n\ntwo"
    assert readers.pages(files, lambda b: 1 / 0).first()["text"] == ""


def test_history(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "id int, v string, at int")
    assert {(r["id"], r["v"]) for r in history.latest(rows, ["id"], "at").collect()} == {(1, "b"), (2, None)}
    assert history.visible(rows, "v", "a", False).count() == 1 and history.visible(rows, "v", "a", False, unknown=True).count() == 2 and history.visible(rows, "v", "z", True).count() == 3


def test_learning(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 7), 1.0) for i in range(400)] + [(1000, 500.0, -400.0, 1.0)], "id int, x double, y double, c double")
    forest = learning.isolation_trees(rows, ["x", "y"], "id", trees=30)
    scored = rows.withColumn("anomaly_score", learning.anomaly_score(forest, ["x", "y"], spark))
    assert scored.orderBy(F.desc("anomaly_score")).first()["id"] == 1000 and learning.outliers(scored, 0.005).where("id = 1000").first()["is_outlier"]
    assert learning.standardise(rows, ["c"]).select("c").distinct().collect()[0]["c"] == 0
    one_class = spark.createDataFrame([(1, 0.5), (1, 0.6)], "label int, score double")
    assert learning.areas(one_class, "label", "score").first()["roc_auc"] is None
    assert features(rows.select(F.lit("s").alias("statement_id"), F.col("id").alias("seq"), F.col("x").alias("amount"))).select(F.size(vector(width=32)).alias("n"), F.size(vector(width=5)).alias("k")).first() == (32, 5)


def test_stream_equals_batch(spark, sf, tmp_path):
    source = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(source))
    batch = spark.read.parquet(str(source))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 3).parquet(str(source))
    query = velocity(stream).writeStream.outputMode("complete").format("memory").queryName("velocity").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    key = lambda df: sorted((r["user_id"], r["window_start"], r["n"], round(r["amount"], 4)) for r in df.collect())
    assert key(spark.sql("select * from velocity")) == key(velocity(batch)) and isinstance(key(velocity(batch))[0][1], datetime.datetime)


def test_prompts_and_responses(spark):
    asked = spark.createDataFrame([(1, "risk?", "a.pdf"), (2, "none?", "b.pdf")], "query_id int, query string, document_name string")
    ranked = spark.createDataFrame([(1, 1, "c1", 3, "Risk", 0.876, 1.0, "x" * 600), (1, 2, "c2", None, None, 0.5, 0.75, "short")], "query_id int, rank int, chunk_id string, page_number int, section_title string, final_score double, confidence double, content string")
    found = {r["query_id"]: r["prompt"] for r in answers.prompts(asked, ranked).collect()}
    assert "[Section 1] Page 3 | Risk (Relevance: 0.88, Confidence: 1.00)" in found[1] and "x" * 500 + "... [truncated]" in found[1] and "[Section 2] (Relevance: 0.50" in found[1]
    assert "No relevant information found" in found[2] and answers.NOT_FOUND in found[2]
    given = spark.createDataFrame([(1, "risk?", "**Answer:** Yes\n indeed\n\n**Source:** Section 1\n**Confidence:** HIGH\n**Context:** c"), (2, "none?", None), (3, "plain?", "no marks")], "query_id int, query string, answer_text string")
    rows = {r["query_id"]: r for r in answers.responses(given, ranked).collect()}
    assert (rows[1]["answer"], rows[1]["source"], rows[1]["confidence"], rows[1]["context"], rows[1]["chunks_retrieved"]) == ("Yes\nindeed", "Section 1", "HIGH", "c", 2)
    assert rows[1]["citations"][0].asDict() == {"chunk_id": "c1", "page": 3, "section": "Risk", "relevance_score": "0.876"}
    assert (rows[2]["answer"], rows[2]["confidence"], rows[2]["citations"]) == (answers.NOT_FOUND, "LOW", []) and (rows[3]["answer"], rows[3]["confidence"]) == ("", "UNKNOWN")


def test_reports(spark):
    tx = [(45000, "debit", "CasinoXYZ"), (12000, "debit", "Gambling House"), (5000, "debit", "Crypto Exchange"), (50000, "credit", "Employer Salary")]
    row = analyse(statement(spark, tx)).withColumn("report_id", F.lit("R")).withColumn("generated", F.lit("now")).withColumn("document_name", F.lit("d.pdf"))
    r = row.select(answers.text_report(F.create_map(F.lit("page_count"), F.lit("3"))).alias("text"), answers.summary_report().alias("line")).first()
    assert "RISK ASSESSMENT" in r["text"] and "1. Transactions with high-risk merchants detected: Casinos" in r["text"] and "Total Debited: $62,000.00" in r["text"] and "Page Count: 3" in r["text"] and r["text"].endswith("=" * 70)
    assert r["line"].startswith("🟢 LOW Risk Score: 14.91/100 | Document: d.pdf | Issues: ") and "Action: No immediate action required" in r["line"]


def test_csv_files_have_headers_of_their_own(spark, tmp_path):
    texts = {
        "a.csv": "date,amount,type,merchant\n2026-01-01,1.5,debit,Shop A\n",
        "b.csv": "Type,Description,Amount,Date\ncredit,\"Salary, main\",2.5,2026-01-02\n",
        "c.csv": "\ufeffMERCHANT,extra,timestamp,type,date,amount\nATM,x,2026-01-03T10:00:00,DEBIT,2026-01-03,3.5\n,y,,debit,2026-01-04,oops\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = readers.transactions_csv(spark, str(tmp_path)).collect()
    found = sorted((r["file"][-5:], r["date"], r["amount"], r["type"], r["merchant"], r["timestamp"]) for r in rows)
    assert found == [("a.csv", "2026-01-01", 1.5, "debit", "Shop A", None), ("b.csv", "2026-01-02", 2.5, "credit", "Salary, main", None), ("c.csv", "2026-01-03", 3.5, "debit", "ATM", "2026-01-03T10:00:00")]
    (tmp_path / "d.csv").write_text("date,amount,merchant\n1,2,3\n")
    with pytest.raises(ValueError, match="missing.*type"):
        readers.transactions_csv(spark, str(tmp_path))


def test_index_life_cycle(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(d, f"{d}{i}", "two words", [3.0, 4.0]) for d in ("a", "b", "c") for i in range(2)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, content string, embedding array<double>")
    readers.write_index(chunks, path, buckets=2)
    assert readers.read_index(spark, path, "b", buckets=2).count() == 2 and "bucket" not in readers.read_index(spark, path).columns
    assert readers.read_index(spark, path).first()["embedding"] == pytest.approx([0.6, 0.8])
    readers.delete_documents(spark, path, spark.createDataFrame([("a",), ("none",)], "document_id string"), buckets=2)
    assert [r["document_id"] for r in readers.documents_in(spark, path).collect()] == ["b", "c"]
    ids = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert {tuple(r) for r in readers.document_exists(spark, path, ids).collect()} == {("a", False), ("b", True)}
    assert {tuple(r) for r in readers.index_stats(spark, path, ids).collect()} == {("a", 0, 0, 0, 0.0), ("b", 2, 18, 4, 9.0)}
    readers.delete_documents(spark, path, spark.createDataFrame([("b",), ("c",)], "document_id string"), buckets=2)
    assert not list((tmp_path / "index").glob("bucket=*"))


def test_quantiles_are_exact(spark):
    import numpy as np

    random = np.random.default_rng(1)
    for values in (random.normal(size=5000).round(2), random.integers(0, 3, 1000).astype(float), np.array([5.0]), np.array([1.0, 2.0]), np.arange(7.0)):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        shares = [0.0, 0.1, 0.5, 0.9, 1.0]
        assert learning.quantiles(rows, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert learning.quantiles(rows.limit(0), "v", [0.5]) == [None]
    several = spark.createDataFrame([(float(a), None if b < -1 else float(b), float("nan"), int(c)) for a, b, c in zip(random.normal(size=3000), random.normal(size=3000), random.integers(0, 9, 3000), strict=True)], "a double, b double, c double, d int")
    found = learning.quantiles_of(several, ["a", "b", "c", "d"], shares)
    table = several.toPandas()
    assert found["c"] == [None] * 5 and all(found[c] == pytest.approx(np.quantile(table[c].dropna(), shares).tolist()) for c in "abd")


def test_detector(spark, tmp_path):
    rows = spark.createDataFrame([(i, *([float(i % 9)] * 29), 1000.0 if i == 7 else float(i % 5)) for i in range(300)], "statement_id int, " + ", ".join(f"{f} double" for f in FEATURES))
    detector = prediction.fit(rows, FEATURES, "statement_id", trees=40, contamination=0.01)
    found = {r["statement_id"]: r for r in prediction.predict(rows, detector).collect()}
    assert max(found, key=lambda i: found[i]["anomaly_score"]) == 7 and found[7]["is_fraud"] and found[7]["feature_alignment_action"] == "none" and 1 <= sum(r["is_fraud"] for r in found.values()) <= 4
    prediction.save(spark, detector, str(tmp_path / "model"))
    again = prediction.load(spark, str(tmp_path / "model"))
    assert {r["statement_id"]: r["anomaly_score"] for r in prediction.predict(rows, again).collect()} == {i: r["anomaly_score"] for i, r in found.items()}
    assert [prediction.alignment(*x) for x in ((30, 30), (28, 30), (32, 30))] == ["none", "padded", "truncated"]
    assert prediction.predict(rows.limit(1), again, names=FEATURES[:4]).first()["feature_alignment_action"] == "padded"
    told = rows.limit(1).select(prediction.metadata(again, "m").alias("m")).first()["m"]
    assert (told["expected_feature_count"], told["provided_feature_count"]) == (30, 30)
    assert sum(t["n"] for t in learning.isolation_trees(rows.withColumn("same", F.lit(1.0)), ["same"], "statement_id", trees=5, sample=50)) == 5 * 50


def test_forest_scores_equal_a_walk(spark):
    tree = {"feature": [0, -1, 1, -1, -1], "cut": [0.5, 0.0, 2.0, 0.0, 0.0], "low": [1, -1, 3, -1, -1], "high": [2, -1, 4, -1, -1], "depth": [0.0, 3.0, 0.0, 2.0, 4.0], "n": 16, "tree": 0}
    rows = spark.createDataFrame([(0.0, 9.0), (1.0, 1.0), (1.0, 2.0)], "x double, y double")
    found = [r["s"] for r in rows.select(learning.anomaly_score([tree], ["x", "y"], spark).alias("s")).collect()]
    assert found == pytest.approx([2 ** (-d / learning.path_length(16)) for d in (3.0, 2.0, 4.0)])


def test_models(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 10), None if i % 13 == 0 else float(i % 7), int(i % 10 > 6)) for i in range(240)], "id int, x double, y double, label int")
    table = training.compare(rows, ["x", "y"], "id", trees=5).collect()
    assert {r["model"] for r in table} == {"logistic_regression", "random_forest", "gradient_boosting", "isolation_forest"} and sorted(r["rank"] for r in table) == [1, 2, 3, 4]
    assert table[0]["model"] != "isolation_forest" and all(0 <= r["train_accuracy"] <= 1 for r in table)
    curve = {r["share"]: r for r in training.learning_curve(rows, ["x", "y"], "id", sizes=(0.5, 1.0), folds=3).collect()}
    assert set(curve) == {0.5, 1.0} and curve[1.0]["rows"] == 160 and curve[1.0]["valid_f1"] > 0.8
    assert training.learning_curve(rows.where("label = 1"), ["x", "y"], "id").count() == 0
    full = learning.impute_median(rows, ["y"]).withColumn("weight", F.lit(1.0))
    model = training.fit(full, ["x", "y"], "gradient_boosting")
    training.save_model(model, str(tmp_path / "m"), ["x", "y"], full.agg(F.count("*").alias("rows"), F.lit(None).cast("double").alias("auc")))
    loaded, names = training.load_model(spark, str(tmp_path / "m"))
    assert names == ["x", "y"] and training.scored(loaded, full).select("id", "score").collect() == training.scored(model, full).select("id", "score").collect()
    assert "rows: 240" in next((tmp_path / "m" / "summary").glob("*.txt")).read_text() and next((tmp_path / "m" / "metrics").glob("*.csv")).read_text().startswith("rows,auc")


def test_text_store_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("my file.v1.pdf", "text one"), ("b", "two")], "name string, text string")
    saved = readers.save_texts(rows, str(tmp_path / "texts"), "20260101120000").collect()
    there = {r["id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "texts")).collect()}
    assert {r["id"] for r in saved} == set(there) and any(i.startswith("my_file.v1_20260101120000_") and len(i.rpartition("_")[2]) == 8 for i in there)
    readers.write_json_lines(rows, str(tmp_path / "json"))
    assert sorted(map(tuple, readers.read_json_lines(spark, str(tmp_path / "json"), "name string, text string").collect())) == [("b", "two"), ("my file.v1.pdf", "text one")]
    nested = spark.createDataFrame([('{"a": {"b": 2.5}}',), ("{}",), ("no json",), (None,)], "v string")
    assert [r["x"] for r in nested.select(readers.json_value("v", "$.a.b", "double").alias("x")).collect()] == [2.5, None, None, None]
    readers.write_reports(rows.withColumnRenamed("text", "report"), str(tmp_path / "reports"))
    assert "text one" in "".join(f.read_text() for f in (tmp_path / "reports").glob("*.txt"))
    cards = spark.createDataFrame([(5.0, 0), (6.0, 1), (None, 1)], "Amount double, Class int").repartition(3)
    assert sorted(r["n"] for r in readers.numbered(cards, "n").collect()) == [0, 1, 2] and readers.card_transactions(cards).count() == 2


def test_evaluation_report(spark, tmp_path):
    cases = spark.createDataFrame([(1, ["Risk"]), (2, ["gone"]), (3, ["x"])], "case_id int, keywords array<string>")
    results = spark.createDataFrame([(1, 1, "nothing", 5.0), (1, 2, "RISKS here", 5.0), (2, 1, "else", 7.0)], "case_id int, rank int, content string, latency_ms double")
    found = evaluation.evaluate(cases, results)
    rows = {r["case_id"]: r for r in found.collect()}
    assert rows[1]["mrr"] == 0.5 and rows[1]["p_at_5"] == 0.5 and rows[1]["success"] and not rows[2]["success"] and rows[3]["retrieved_chunks"] == 0
    total = evaluation.summary(found).first()
    assert (total["total_tests"], total["successful"], total["mean_latency_ms"]) == (3, 1, 4.0)
    evaluation.write_report(found, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "results")).count() == 3 and spark.read.json(str(tmp_path / "report" / "summary")).first()["total_tests"] == 3
    assert evaluation.summary(found.limit(0)).first()["success_rate"] == 0


def test_chunks_equal_a_plain_fold(spark, sf):
    """Chunks of all documents against the rule of the docstring, document by document."""
    import re

    found = {}
    for r in QUERIES["chunks"](spark, sf).collect():
        found.setdefault(r["doc_id"], []).append((r["position"], r["content_md5"], r["page_number"]))
    import hashlib

    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        body, parts = r["text"] or "", []

        def pack(pieces, joiner):
            out, now = [], ""
            for p in (x for x in pieces if x.strip()):
                if len(now) + len(p) > 2000:
                    out += [now] if now else []
                    now = p
                else:
                    now = f"{now}{joiner}{p}" if now else p
            return [*out, now] if now else out

        for p in pack(re.split(r"\n\n+", body), "\n\n"):
            parts += pack(re.split(r"(?<=[.!?])\s+(?=[A-Z])", p), " ") if len(p) > 2000 else [p]
        want = []
        for i, c in enumerate(parts):
            if i:
                end = parts[i - 1][-800:]
                at = end.rfind(" ")
                c = (parts[i - 1] if len(parts[i - 1]) <= 800 else end[at:] if at > 0 else end) + "\n\n" + c
            where = body.find(c)
            want.append((i, hashlib.md5(c.encode()).hexdigest(), None if where < 0 else where // 3000 + 1))
        assert sorted(found.get(str(r["doc_id"]), [])) == want


def test_clean_texts_equal_the_rule(spark, sf):
    import hashlib
    import re
    import unicodedata

    found = {r["doc_id"]: r["clean_md5"] for r in QUERIES["document_clean"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        lines = [re.sub(r"[ \t\f\x0b]+", " ", x).strip(" ") for x in re.split(r"\r\n?|\n", unicodedata.normalize("NFKC", r["text"] or ""))]
        assert found[r["doc_id"]] == (hashlib.md5("\n".join(x for x in lines if x).encode()).hexdigest() if r["text"] is not None else None)


def test_first_seen_records(spark):
    rows = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 01:00:00"), (2, "2026-01-01 00:30:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    from ledgerlens.streaming.velocity import first_seen

    assert sorted(r["user_id"] for r in first_seen(rows, "user_id").collect()) == [1, 2]


def test_cache_by_document_and_model(spark):
    texts = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("b", "three")], "document_id string, content string")
    cache = retrieval.embed_missing(texts.where("document_id = 'a'"), spark.createDataFrame([], "document_id string, model string, md5 string, vector array<float>"), retrieval.embed(4))
    cache = cache.drop("cached").withColumn("vector", F.array(F.lit(9.0).cast("float")))
    found = {(r["document_id"], r["cached"], len(r["vector"])) for r in retrieval.embed_missing(texts, cache, retrieval.embed(4)).collect()}
    assert found == {("a", True, 1), ("b", False, 4)} and retrieval.embed_missing(texts, cache, retrieval.embed(4)).count() == 3
    assert not retrieval.embed_missing(texts, cache, retrieval.embed(4), force_refresh=True).where("cached").count()
    joined = retrieval.with_vectors(spark.createDataFrame([("c1",), ("c2",)], "chunk_id string"), spark.createDataFrame([("c2", [1.0])], "chunk_id string, vector array<double>"))
    assert {r["chunk_id"]: r["vector"] for r in joined.collect()} == {"c1": None, "c2": [1.0]}
