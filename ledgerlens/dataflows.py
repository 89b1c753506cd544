"""Queries that join the parts: streams into stored tables, statement text to reports, files, search indexes and SQL, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import queries as own
from ledgerlens.functions import metrics, storage, tables
from ledgerlens.functions.text import rounded
from ledgerlens.operators import answers, history, language, prediction, requests, retrieval, scoring, semantic, vector_index
from ledgerlens.operators.transactions import STEPS, parse
from ledgerlens.plans import sql_surface
from ledgerlens.plans.risk import analyse, analyse_text
from ledgerlens.sources import blobs, readers, upserts
from ledgerlens.streaming import takeover

table = own.table


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern matches a file and a folder of that name alike."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def risk_takeover_stream(spark, d):
    """The stateful detector over events as a stream, its alerts upserted by account, of which the newest is left."""
    path = storage.work_path(spark, "takeover")
    e = stream(spark, d, "events")
    rows = e.select(F.col("user_id").alias("statement_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "signup", "credit").otherwise("debit").alias("type"), own.named(F.col("event_type"), own.MERCHANTS).alias("merchant"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", takeover.ROCKS)
    try:
        put = upserts.sink(f"{path}/table", ["statement_id"], "latest", "takeover")
        takeover.takeover_stream(rows).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return upserts.current(spark, f"{path}/table").select("statement_id", "takeover_score", "transactions")


def history_upsert(spark, d):
    """Events as three batches of a history by user, of which the second is replayed and the first comes again late: one row a user, the newest."""
    path = storage.work_path(spark, "history")
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    for batch, part in ((0, 0), (1, 1), (1, 1), (2, 2), (3, 0)):
        upserts.upsert(rows.where(F.col("event_id") % 3 == part), path, ["user_id"], "ts", "events", batch)
    return upserts.current(spark, path).select("user_id", "event_id", "event_type", "value")


def history_insert_unique(spark, d):
    """Customers of orders inserted once each, batch by batch with one replayed, and how often each was refused."""
    path = storage.work_path(spark, "inserts")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    for batch, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        upserts.insert_unique(rows.where(F.col("o_orderkey") % 3 == part), path, ["o_custkey"], "orders", batch, "o_orderkey")
    refused = upserts.conflicts(spark, path).groupBy("o_custkey").agg(F.sum(F.when(F.col("reason") == "repeated", F.col("rows"))).alias("repeated"), F.count_if(F.col("reason") == "exists").alias("batches"))
    found = upserts.current(spark, path).join(refused, "o_custkey", "left")
    return found.select("o_custkey", "o_orderkey", F.coalesce("repeated", F.lit(0)).alias("repeated"), F.coalesce("batches", F.lit(0)).alias("batches"))


#: Merchants of statement lines, by an order's priority; none holds a noise word.
SHOPS = {"1-URGENT": "ATM Cash Withdrawal", "2-HIGH": "Barnes Books", "3-MEDIUM": "Employer Salary", "4-NOT SPECIFIED": "Casino Royal"}


def statements(spark: SparkSession, d: str) -> DataFrame:
    """A statement of text per customer: orders as lines of four shapes, between lines that hold no transaction."""
    o, day, shop = table(spark, d, "orders"), F.col("o_orderdate"), F.coalesce(own.named(F.col("o_orderpriority"), SHOPS), F.lit("Wire Intl"))
    amount, sign = F.format_string("%.2f", "o_totalprice"), F.when(F.col("o_orderstatus") == "F", "CR").otherwise("DR")
    shapes = [
        F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit("  INR "), F.format_number("o_totalprice", 2), sign, F.lit(" | "), shop, F.lit(" ref 12")),
        F.concat(F.date_format(day, "d MMM yyyy"), F.lit(" NEFT "), shop, F.lit(" ₹"), amount, F.lit(" "), sign, F.lit(" 999999.99")),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 123456789 "), amount, F.lit(" "), sign, F.lit(" "), shop, F.lit(" txn\r")),
        F.concat(F.date_format(day, "MMM d, yyyy"), F.lit("\tRs."), amount, F.initcap(sign), F.lit(" to "), shop),
    ]
    line = F.coalesce(*[F.when(F.col("o_orderkey") % 4 == i, shape) for i, shape in enumerate(shapes)])  # an array would write all four
    noise = F.element_at(F.array(*map(F.lit, ["Opening Balance 5.00", "no date 12.00", "31/02/2025 12.00 DR nowhere", "05/01/2025 nothing", ""])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    found = o.select("o_custkey", F.struct("o_orderkey", F.concat_ws("\n", line, noise).alias("t")).alias("l")).groupBy(F.col("o_custkey").alias("statement_id")).agg(F.sort_array(F.collect_list("l")).alias("l"))
    return found.select("statement_id", F.array_join("l.t", "\n").alias("text"))


def statement_report(spark, d):
    """Statement text to hybrid verdict: lines, transactions, features, the detector as saved and read again, take-over, advice."""
    path = storage.work_path(spark, "detector")
    prediction.save(spark, own.SMALL_DETECTOR, path)
    found = analyse_text(statements(spark, d), prediction.load(spark, path), "small")
    rows = found.select("statement_id", "anomaly_score", "model_risk", "model_flag", "model_level", "rule_score", "combined_score", "takeover_score", "risk_score", "is_fraud", "hybrid_level", "risk_level", "verdict", "recommendation", "model.feature_alignment_action")
    return own.rounded(own.rounded(rows, ["anomaly_score", "model_risk"], 6), ["rule_score", "combined_score", "risk_score"], 3, own.SHIFT)


def statement_parse_sql(spark, d):
    """All statement lines by the table function, from SQL alone."""
    tables.register(spark)
    statements(spark, d).createOrReplaceTempView("statement_texts")
    return spark.sql("SELECT s.statement_id, p.date, p.amount, p.type, p.merchant FROM statement_texts s, LATERAL parse_statement(s.text) p")


def parser_metrics(spark, d):
    """What each step of the parser has let through and dropped, observed during one run."""
    run = metrics.Run("parse")
    run.timed("parse", lambda: parse(statements(spark, d), observe=run.step).write.format("noop").mode("overwrite").save())
    told = run.frame(spark)
    kept = told.where("metric = 'rows'").select("step", F.col("value").cast("long").alias("rows"))
    return kept.join(metrics.dropped(told, STEPS).select("step", "dropped"), "step", "left")


def risk_verdict_sql(spark, d):
    """The verdict over customers' orders, written in SQL alone."""
    sql_surface.register(spark, own.order_transactions(spark, d))
    return spark.sql("""
SELECT statement_id, round(rule, 4) AS rule_score, round(risk_score * 1000D) / 1000D AS risk_score, is_fraud, hybrid_level(rule, 0D) AS hybrid_level, risk_band(risk_score, 'report') AS risk_level,
       risk_band(risk_score, 'confidence') AS confidence, risk_verdict_text(risk_score, is_fraud) AS verdict, risk_recommendation(risk_score, is_fraud) AS recommendation
FROM statement_risk""")


def report_subtotals(spark, d):
    """Reports, their owners and mean scores by level, month and owner, with all subtotals."""
    rows = table(spark, d, "orders").select(scoring.band((F.col("o_orderkey") % 101).cast("double"), "report").alias("risk_level"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 12).alias("owner"), "o_custkey", (F.col("o_orderkey") % 101).cast("double").alias("score"))
    found = history.subtotals(rows, ["risk_level", "month", "owner"], {"reports": F.count("*"), "customers": F.countDistinct("o_custkey"), "mean_score": F.avg("score"), "high_scores": F.count_if(F.col("score") >= 70)})
    return own.rounded(found, ["mean_score"], 4, own.SHIFT)


def risk_dashboard(spark, d):
    """What the dashboard shows of each statement; reasons that speak of a take-over raise it."""
    rows = analyse(own.order_transactions(spark, d))
    shown = scoring.dashboard(F.col("risk_score") / F.when(F.col("statement_id") % 2 == 0, 100.0).otherwise(1.0), F.col("is_fraud"), F.col("reasons"))
    return rows.select("statement_id", shown.alias("v")).select("statement_id", rounded(F.col("v.score"), 3).alias("score"), "v.level", "v.override", "v.fraud_flag")


def requests_checked(spark, d):
    """Turns of conversations as requests, with what is wrong with each."""
    c = table(spark, d, "conversations")
    asked = c.select("conv_id", "turn", F.when(F.col("turn") % 3 != 1, F.col("text")).otherwise(" \t\u00a0").alias("query"), F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("doc_"), F.col("conv_id"), F.when(F.col("conv_id") % 5 == 0, "/x").otherwise(""))).alias("document_id"), (F.col("turn") * 9 - 5).cast("string").alias("top_k"))
    found = requests.validated(asked, ["query", "document_id"], {"query": (3, 500)}, {"top_k": (1, 50)}, {"document_id": "^[A-Za-z0-9_-]+$"})
    return found.select("conv_id", "turn", "status", F.array_join("errors.message", "; ").alias("errors"))


def rag_responses(spark, d):
    """The whole answer to each query: parsed text, citations of the five best chunks, or the error envelope where the model gave nothing."""
    best = retrieval.rerank(own.hits(spark, d), 5).withColumn("page_number", (F.col("chunk_id") % 3).cast("int"))
    texts = F.when(F.col("vec_id") % 150 == 0, None).when(F.col("vec_id") % 100 == 0, answers.MOCK_ANSWER).otherwise(F.concat(F.lit("- **Answer:** number "), F.col("vec_id").cast("string"), F.lit("\n- **Confidence:** HIGH")))
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("risk").alias("query"), texts.alias("answer_text"))
    cited = F.transform("citations", lambda c: F.concat_ws("|", c["chunk_id"].cast("string"), c["page"].cast("string"), c["section"], c["relevance_score"]))
    return answers.responses(asked, best).withColumn("citations", F.array_join(cited, " "))


def counting_client(prompts: list[str], system: str) -> list[str]:
    """A stand-in for a model: urgent advice at any score, summaries that tell the prompt's length, and no answer to prompts of odd length."""
    if system == language.ADVISER:
        return ["URGENT: Immediate account review of this statement."] * len(prompts)
    if any(len(p) % 2 for p in prompts):
        raise TimeoutError("no answer")
    return [f" The prompt has {len(p)} characters.\n" for p in prompts]


def language_reports(spark, d):
    """Summaries and recommendations of all statements by a client that fails at times, with the offline texts in its place."""
    rows = analyse(own.order_transactions(spark, d)).withColumn("document_name", F.concat(F.col("statement_id").cast("string"), F.lit(".pdf")))
    found = language.report_texts(rows, counting_client, F.floor("risk_score").cast("long"))
    return found.select("statement_id", "llm_summary", "summary_by", "llm_recommendation", "recommendation_by", F.size("llm_errors").alias("errors"))


def csv_transactions(spark, d):
    """Orders written as CSV files, with quotes and line breaks in their cells, and read back as transactions."""
    path = storage.work_path(spark, "csv")
    o = table(spark, d, "orders")
    merchant = F.concat(F.lit("Shop \""), F.col("o_custkey").cast("string"), F.lit("\",\nsecond line\r\n"), F.col("o_orderpriority"))
    kind = F.when(F.col("o_orderkey") % 11 == 0, "transfer").when(F.col("o_orderstatus") == "F", "Credit").otherwise("DEBIT")
    rows = o.select(kind.alias("Type"), merchant.alias("description"), F.when(F.col("o_orderkey") % 13 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("AMOUNT"), F.col("o_orderkey").alias("note"), F.date_format("o_orderdate", "yyyy-MM-dd").alias(" date"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("maxRecordsPerFile", 100_000).csv(path)
    found = readers.transactions_csv(spark, f"{path}/*.csv")
    return found.select("date", "amount", "type", F.md5("merchant").alias("merchant_md5"))


def training_rows(spark, d):
    """Lineitems written as a labelled CSV table and read back: numeric columns only, and the label."""
    path = storage.work_path(spark, "training")
    li = table(spark, d, "lineitem")
    li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("Amount"), "l_discount", "l_shipmode" if "l_shipmode" in li.columns else F.col("l_returnflag"), F.when(F.col("l_linenumber") < 7, (F.col("l_quantity") > 25).cast("int")).alias("isFraud")).write.option("header", True).csv(path)
    return readers.training_csv(spark, path)


def card_rows(spark, d):
    """Card rows as statements of one transaction each; rows without amount or class are left out."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice")).alias("Amount"), F.when(F.col("l_partkey") % 7 != 0, (F.col("l_returnflag") == "R").cast("int")).alias("Class"))
    return readers.card_transactions(rows, "row")


def stored_texts(spark, d):
    """Documents' texts saved in the text store, under ids of their own, and read back."""
    path = storage.work_path(spark, "texts")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc no "), F.col("doc_id").cast("string"), F.lit(".v1.pdf")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    saved = readers.save_texts(docs, path, "20260101")
    rows = spark.read.parquet(path).join(saved.withColumnRenamed("name", "told"), "id")
    return rows.select("name", F.col("told"), F.regexp_replace("id", "[0-9a-f]{8}$", "").alias("id_stem"), F.length("id").alias("id_chars"), F.md5("text").alias("text_md5"))


def blob_cycle(spark, d):
    """Documents as stored files: put, some put again, some deleted, then what is told of all of them and what their chunks give when they are read."""
    path = storage.work_path(spark, "blobs")
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("blob_id"), F.concat(F.lit("doc "), F.col("doc_id"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    blobs.put(t.select("blob_id", "name", F.col("text").cast("binary").alias("content")), path, "2026-01-01", chunk=1000, batch=0)
    blobs.put(t.where("doc_id % 10 = 3").select("blob_id", "name", F.concat(F.lit("new "), "text").cast("binary").alias("content")), path, "2026-01-02", chunk=700, batch=1)
    blobs.delete(t.where("doc_id % 10 = 4"), path)
    read = blobs.get(spark, path).groupBy("blob_id").agg(F.count("*").alias("read_chunks"), F.sum(F.octet_length("data")).alias("read_bytes"))
    told = blobs.info(spark, path, t).join(read, "blob_id", "left")
    return told.select("blob_id", "found", "name", "length", "chunks", "sha256", F.coalesce("read_chunks", F.lit(0)).alias("read_chunks"), F.coalesce("read_bytes", F.lit(0)).alias("read_bytes"))


def vector_search_indexed(spark, d):
    """The nearest vectors of the same label, through the index and its bounds."""
    asked, vectors = own.asked(spark, d)
    index = vector_index.build(vectors, storage.work_path(spark, "vectors"))
    found, _ = vector_index.search(asked, index, 10, key="document_id")
    return found.withColumn("similarity", F.round("similarity", 5))


def semantic_neighbours(spark, d):
    """The five nearest documents of every fiftieth one's text without its first half, by embeddings that are fitted to all others, through the index."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vectors = semantic.embedder(semantic.fit(docs.where("doc_id % 50 <> 0")), spark)
    index = vector_index.build(docs.select(F.col("doc_id").alias("chunk_id"), vectors(F.col("text")).cast("array<double>").alias("v")), storage.work_path(spark, "semantic"))
    half = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.expr("substring(text, CAST(length(text) / 2 AS INT) + 1)").alias("half"))
    found, _ = vector_index.search(half.select("query_id", vectors(F.col("half")).cast("array<double>").alias("q")), index, 5)
    return found.withColumn("similarity", F.round("similarity", 6))


QUERIES = {
    q.__name__: q
    for q in (language_reports, csv_transactions, training_rows, card_rows, stored_texts, blob_cycle, vector_search_indexed, semantic_neighbours, risk_takeover_stream, history_upsert, history_insert_unique, statement_report, statement_parse_sql, parser_metrics, risk_verdict_sql, report_subtotals, risk_dashboard, requests_checked, rag_responses)
}

_SHOP = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHOPS.items()) + " ELSE 'Wire Intl' END"
_LINES = f"SELECT o_custkey AS statement_id, o_orderkey AS seq, CAST(NULL AS TIMESTAMP) AS ts, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount, CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS type, {_SHOP} AS merchant FROM orders"
_MODEL = f""", x AS (SELECT *, (total_transactions - 10) / 5 AS x0, total_credits - 2 AS x2, (debit_credit_ratio - 4) / 2 AS x3, {own.RULE_SQL} AS rule_score FROM f JOIN taken USING (statement_id)),
p AS (SELECT *, pow(2.0, -((CASE WHEN x0 < 0.5 THEN 4.0 ELSE 1.0 END + CASE WHEN x3 < -1 THEN 1.0 WHEN x2 < 0.25 THEN 5.0 ELSE 2.0 END) / 2) / (2 * (ln(7.0::DOUBLE) + {own.learning.EULER}) - 14.0 / 8)) AS a FROM x),
q AS (SELECT *, 1 / (1 + exp(-8 * (a - 0.58))) AS r, a > 0.6 AS flagged FROM p),
c AS (SELECT *, round(0.2 * rule_score + 0.8 * 100 * r, 4) AS combined_score FROM q),
h AS (SELECT *, greatest(combined_score, takeover_score) AS risk_score, (r >= 0.9 OR rule_score >= 75 OR (combined_score >= 55 AND (r >= 0.6 OR rule_score >= 45)) OR (flagged AND (r >= 0.55 OR rule_score >= 20))) OR takeover_score >= 70 AS is_fraud FROM c)
"""
_WHITE = own._WHITE

ORACLE_SQL = {
    "risk_takeover_stream": f"WITH tx AS ({own.EVENTS_SQL}), {own.TAKEOVER_SQL} SELECT statement_id, CAST(takeover_score AS DOUBLE) AS takeover_score, n AS transactions FROM taken JOIN (SELECT statement_id, n FROM counts) USING (statement_id)",
    "history_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
    "history_insert_unique": """
WITH per AS (SELECT o_custkey, o_orderkey % 3 AS part, min(o_orderkey) AS first, count(*) - 1 AS again FROM orders GROUP BY 1, 2)
SELECT o_custkey, arg_min(first, part) AS o_orderkey, CAST(sum(again) AS BIGINT) AS repeated, count(*) - 1 AS batches FROM per GROUP BY 1""",
    "statement_report": f"WITH tx AS ({_LINES}), {own.FEATURES_SQL}, {own.TAKEOVER_SQL}{_MODEL}" + f"""
SELECT statement_id, round(a, 6) AS anomaly_score, round(r, 6) AS model_risk, flagged AS model_flag, {own._band('r', 'inference')} AS model_level, round(rule_score + {own.SHIFT:.7f}, 3) AS rule_score, round(combined_score + {own.SHIFT:.7f}, 3) AS combined_score,
       CAST(takeover_score AS DOUBLE) AS takeover_score, round(risk_score + {own.SHIFT:.7f}, 3) AS risk_score, is_fraud,
       CASE WHEN combined_score >= 70 OR r >= 0.75 OR rule_score >= 75 THEN 'high' WHEN combined_score >= 50 OR r >= 0.5 OR rule_score >= 50 THEN 'medium' ELSE 'low' END AS hybrid_level, {own._band('risk_score', 'report')} AS risk_level,
       CASE WHEN is_fraud AND risk_score >= 70 THEN 'HIGH RISK - Fraudulent activity strongly suspected' WHEN is_fraud THEN 'MEDIUM RISK - Suspicious activity detected'
            WHEN risk_score >= 45 THEN 'MEDIUM RISK - Some unusual patterns detected' ELSE 'LOW RISK - Activity appears normal' END AS verdict,
       CASE WHEN is_fraud AND risk_score >= 70 THEN '{own._ADVICE["urgent"]}' WHEN is_fraud AND risk_score >= 45 THEN '{own._ADVICE["review"]}' WHEN risk_score >= 45 THEN '{own._ADVICE["enhanced"]}'
            WHEN risk_score >= 35 THEN '{own._ADVICE["standard"]}' ELSE '{own._ADVICE["none"]}' END AS recommendation, 'truncated' AS feature_alignment_action FROM h""",
    "statement_parse_sql": f"SELECT statement_id, strftime(day, '%Y-%m-%d') AS date, round(amount, 2) AS amount, type, merchant FROM ({_LINES})",
    "parser_metrics": """
WITH l AS (SELECT unnest(CASE o_orderkey % 5 WHEN 0 THEN [0, 4] WHEN 1 THEN [1, 4] WHEN 2 THEN [2, 4] WHEN 3 THEN [3, 4] ELSE [4] END) AS k FROM orders),
n AS (SELECT 'lines' AS step, count(*) AS rows, NULL AS dropped FROM l UNION ALL SELECT 'unmarked', count(*) FILTER (k <> 0), count(*) FILTER (k = 0) FROM l UNION ALL SELECT 'dated', count(*) FILTER (k >= 2), count(*) FILTER (k = 1) FROM l
  UNION ALL SELECT 'readable', count(*) FILTER (k >= 3), count(*) FILTER (k = 2) FROM l UNION ALL SELECT 'amounts', count(*) FILTER (k = 4), count(*) FILTER (k = 3) FROM l)
SELECT step, rows, CAST(dropped AS BIGINT) AS dropped FROM n""",
    "language_reports": own._EXPLAINED + f""", prompts AS ({own.ORACLE_SQL["report_prompts"].removeprefix(own._EXPLAINED)}),
z AS (SELECT t.*, length(p.summary) AS n, CAST(floor(risk_score) AS BIGINT) AS s FROM told t JOIN prompts p USING (statement_id))
SELECT statement_id, CASE WHEN n % 2 = 0 THEN 'The prompt has ' || n || ' characters.' ELSE 'This analysis identified a risk score of ' || s || '/100 with ' || CASE WHEN is_fraud THEN 'fraudulent activity detected' ELSE 'no fraud detected' END
  || '. ' || len(reasons) || ' suspicious patterns were flagged. ' || CASE WHEN is_fraud THEN 'Immediate manual review is recommended.' ELSE 'Standard monitoring procedures apply.' END END AS llm_summary,
  CASE WHEN n % 2 = 0 THEN 'model' ELSE 'offline' END AS summary_by, CASE WHEN s >= 70 THEN 'URGENT: Immediate account review of this statement.' WHEN is_fraud AND s >= 45 THEN '{own._ADVICE["review"]}' WHEN s >= 45 THEN '{own._ADVICE["enhanced"]}'
  WHEN s >= 35 THEN '{own._ADVICE["standard"]}' ELSE '{own._ADVICE["none"]}' END AS llm_recommendation, CASE WHEN s >= 70 THEN 'model' ELSE 'offline' END AS recommendation_by, CAST(n % 2 AS INTEGER) AS errors FROM z""",
    "csv_transactions": """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS amount, CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS type,
       md5('Shop "' || o_custkey || '",' || chr(10) || 'second line' || chr(13) || chr(10) || o_orderpriority) AS merchant_md5 FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""",
    "training_rows": "SELECT l_orderkey, l_linenumber, l_quantity AS Amount, l_discount, CAST(l_quantity > 25 AS INTEGER) AS label FROM lineitem WHERE l_linenumber < 7",
    "card_rows": """
WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS i, l_extendedprice AS amount, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_partkey % 7 <> 0)
SELECT CAST(i AS VARCHAR) AS statement_id, CAST(0 AS BIGINT) AS seq, '2024-01-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') || ' 12:00:00' AS date, amount, 'debit' AS type, 'Merchant_' || (i % 100) AS merchant, label FROM c""",
    "stored_texts": """
SELECT 'doc no ' || doc_id || '.v1.pdf' AS name, 'doc no ' || doc_id || '.v1.pdf' AS told, 'doc_no_' || doc_id || '.v1_20260101_' AS id_stem, CAST(length('doc_no_' || doc_id || '.v1_20260101_') + 8 AS INTEGER) AS id_chars, md5(coalesce(text, '')) AS text_md5 FROM documents""",
    "blob_cycle": """
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'new ' ELSE '' END || coalesce(text, '') AS x, CASE WHEN doc_id % 10 = 3 THEN 700 ELSE 1000 END AS c, doc_id % 10 <> 4 AS found FROM documents),
n AS (SELECT *, strlen(x) AS n FROM t)
SELECT CAST(doc_id AS VARCHAR) AS blob_id, found, CASE WHEN found THEN 'doc ' || doc_id || '.txt' END AS name, CASE WHEN found THEN CAST(n AS BIGINT) END AS length, CASE WHEN found THEN CAST(ceil(n / c) AS INTEGER) END AS chunks,
       CASE WHEN found THEN sha256(x) END AS sha256, CAST(CASE WHEN found THEN ceil(n / c) ELSE 0 END AS BIGINT) AS read_chunks, CAST(CASE WHEN found THEN n ELSE 0 END AS BIGINT) AS read_bytes FROM n""",
    "vector_search_indexed": own.ORACLE_SQL["vector_search"],
    "risk_verdict_sql": own.ORACLE_SQL["risk_verdict"],
    "report_subtotals": f"""
WITH r AS (SELECT {own._band('o_orderkey % 101', 'report')} AS risk_level, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 12 END AS owner, o_custkey, CAST(o_orderkey % 101 AS DOUBLE) AS score FROM orders)
SELECT risk_level, month, owner, count(*) AS reports, count(DISTINCT o_custkey) AS customers, round(avg(score) + {own.SHIFT:.7f}, 4) AS mean_score, count(*) FILTER (score >= 70) AS high_scores,
       CAST(3 - bit_count(grouping(risk_level, month, owner)) AS INTEGER) AS level FROM r GROUP BY ROLLUP (risk_level, month, owner)""",
    "risk_dashboard": own._EXPLAINED + f"""
, s AS (SELECT statement_id, risk_score / CASE WHEN statement_id % 2 = 0 THEN 100.0 ELSE 1.0 END AS raw, is_fraud, len(list_filter(reasons, lambda x: regexp_matches(lower(x), 'account takeover|cash-out|cash out'))) > 0 AS override FROM told),
u AS (SELECT *, CASE WHEN raw <= 1 THEN raw * 100 ELSE raw END AS score FROM s)
SELECT statement_id, round(score, 3) AS score, CASE WHEN override THEN 'HIGH' ELSE {own._band('score', 'report')} END AS level, override, is_fraud AND (score >= 70 OR override) AS fraud_flag FROM u""",
    "requests_checked": f"""
WITH a AS (SELECT conv_id, turn, trim(coalesce(CASE WHEN turn % 3 <> 1 THEN text END, ''), {_WHITE}) AS query, CASE WHEN conv_id % 7 <> 0 THEN 'doc_' || conv_id || CASE WHEN conv_id % 5 = 0 THEN '/x' ELSE '' END END AS doc, turn * 9 - 5 AS k FROM conversations),
e AS (SELECT conv_id, turn, list_filter([CASE WHEN query = '' THEN 'query is required' END, CASE WHEN doc IS NULL THEN 'document_id is required' END, CASE WHEN query <> '' AND length(query) NOT BETWEEN 3 AND 500 THEN 'query must have 3 to 500 characters' END,
  CASE WHEN k NOT BETWEEN 1 AND 50 THEN 'top_k must be from 1 to 50' END, CASE WHEN contains(doc, '/') THEN 'document_id is malformed' END], lambda x: x IS NOT NULL) AS e FROM a)
SELECT conv_id, turn, CASE WHEN len(e) > 0 THEN 400 ELSE 200 END AS status, array_to_string(e, '; ') AS errors FROM e""",
    "rag_responses": own._RANKED + """,
told AS (SELECT query_id, string_agg(chunk_id || '|' || chunk_id % 3 || '|Risk ' || source || '|' || printf('%.3f', fs), ' ' ORDER BY rank) AS citations, count(*) AS n FROM ranked WHERE rank <= 5 GROUP BY 1)
SELECT vec_id AS query_id, 'risk' AS query, CASE WHEN vec_id % 150 = 0 THEN 'Information not found in document.' WHEN vec_id % 100 = 0 THEN 'Based on the retrieved document sections, the information appears to indicate [specific data from context].' ELSE 'number ' || vec_id END AS answer,
       CASE WHEN vec_id % 150 = 0 THEN 'N/A' WHEN vec_id % 100 = 0 THEN 'Financial Summary section, page 2-3' ELSE '' END AS source, CASE WHEN vec_id % 150 = 0 THEN 'LOW' WHEN vec_id % 100 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
       CASE WHEN vec_id % 150 = 0 THEN 'Error: no answer' WHEN vec_id % 100 = 0 THEN 'This information is extracted from multiple document sections and synthesized based on the most relevant retrieved segments.' ELSE '' END AS context,
       CASE WHEN vec_id % 150 = 0 THEN '' ELSE coalesce(citations, '') END AS citations, CAST(CASE WHEN vec_id % 150 = 0 THEN 0 ELSE coalesce(n, 0) END AS INTEGER) AS chunks_retrieved
FROM embeddings LEFT JOIN told ON query_id = vec_id WHERE vec_id % 50 = 0""",
}
