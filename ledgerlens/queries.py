"""Queries of the engine over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import merchants as m
from ledgerlens.functions import storage
from ledgerlens.functions import text as t
from ledgerlens.functions.batches import spread
from ledgerlens.operators import answers, documents, evaluation, explain, history, learning, prediction, retrieval, scoring
from ledgerlens.operators.features import FEATURES, features
from ledgerlens.operators.transactions import parse
from ledgerlens.plans import training
from ledgerlens.plans.risk import analyse
from ledgerlens.sources import readers
from ledgerlens.streaming.velocity import velocity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MERCHANTS = {"purchase": "Casino Royal", "error": "ATM Cash Withdrawal", "view": "Grocery Mart", "click": "Bitcoin Exchange", "signup": "Salary Deposit"}


def named(column: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(column == k, v) for k, v in names.items()])


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per user, in time order; sign-ups are credits."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("statement_id"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("date"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("value").alias("amount"), F.when(F.col("event_type") == "signup", "credit").otherwise("debit").alias("type"), named(F.col("event_type"), MERCHANTS).alias("merchant"),
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per customer with dates only; finished orders are credits."""
    o = table(spark, sf_dir, "orders")
    names = {"1-URGENT": "Wire Transfer Intl", "2-HIGH": "Barnes Books", "3-MEDIUM": "Employer Salary", "4-NOT SPECIFIED": "Unknown Shop", "5-LOW": "Crypto Exchange"}
    return o.select(
        F.col("o_custkey").alias("statement_id"), F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "credit").otherwise("debit").alias("type"), F.coalesce(named(F.col("o_orderpriority"), names), F.lit("Other")).alias("merchant"),
    )


EVENTS_SQL = """
SELECT user_id AS statement_id, event_id AS seq, date_trunc('second', ts) AS ts, CAST(ts AS DATE) AS day, value AS amount, CASE WHEN event_type = 'signup' THEN 'credit' ELSE 'debit' END AS type,
       CASE event_type WHEN 'purchase' THEN 'Casino Royal' WHEN 'error' THEN 'ATM Cash Withdrawal' WHEN 'view' THEN 'Grocery Mart' WHEN 'click' THEN 'Bitcoin Exchange' ELSE 'Salary Deposit' END AS merchant
FROM events"""
ORDERS_SQL = """
SELECT o_custkey AS statement_id, o_orderkey AS seq, CAST(NULL AS TIMESTAMP) AS ts, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount, CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS type,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Wire Transfer Intl' WHEN '2-HIGH' THEN 'Barnes Books' WHEN '3-MEDIUM' THEN 'Employer Salary' WHEN '4-NOT SPECIFIED' THEN 'Unknown Shop' WHEN '5-LOW' THEN 'Crypto Exchange' ELSE 'Other' END AS merchant
FROM orders"""

ANY = "|".join
MARKED_SQL = rf"""
SELECT statement_id, seq, ts, day, nullif(amount, 0) AS amount, type = 'debit' AS debit, type = 'credit' AS credit, merchant, lower(merchant) AS low,
       regexp_matches(lower(merchant), '\b({ANY(m.HIGH_RISK)})') AS high_risk, regexp_matches(lower(merchant), '\b({ANY(m.SENSITIVE)})') AS sensitive,
       regexp_matches(lower(merchant), '\b({ANY(m.LEGITIMATE)})') AS legitimate, regexp_matches(lower(merchant), '{ANY(m.CASH_LIKE)}') AS cash
FROM tx"""

FEATURES_SQL = f"""
marked AS ({MARKED_SQL}),
wide AS (
  SELECT *, lag(merchant, 1) OVER s AS m1, lag(merchant, 2) OVER s AS m2, row_number() OVER (PARTITION BY statement_id ORDER BY amount NULLS LAST) AS rk,
         count(amount) OVER w AS n, avg(CASE WHEN debit THEN amount END) OVER w AS mean_debit, max(ts) OVER w AS last
  FROM marked WINDOW w AS (PARTITION BY statement_id), s AS (PARTITION BY statement_id, (NOT legitimate AND NOT sensitive) ORDER BY seq)),
cut AS (SELECT statement_id, max(CASE WHEN amount IS NOT NULL AND rk = floor(n * 0.75) + 1 THEN amount END) AS threshold FROM wide GROUP BY 1),
a AS (
  SELECT w.statement_id, CAST(count(*) AS DOUBLE) AS total_transactions, CAST(count(*) FILTER (debit) AS DOUBLE) AS total_debits, CAST(count(*) FILTER (credit) AS DOUBLE) AS total_credits,
         count(DISTINCT day) AS days, avg(amount) AS mean, max(amount) AS largest, min(amount) AS least, stddev_samp(amount) AS std, median(amount) AS med,
         CAST(count(*) FILTER (amount >= threshold) AS DOUBLE) AS high_value, CAST(count(*) FILTER (high_risk) AS DOUBLE) AS hr, CAST(count(*) FILTER (legitimate) AS DOUBLE) AS legit, CAST(count(DISTINCT low) AS DOUBLE) AS uniq,
         CAST(count(*) FILTER (NOT legitimate AND NOT sensitive AND m2 IS NOT NULL AND (merchant = m1 OR merchant = m2 OR m1 = m2)) AS DOUBLE) AS rapid, CAST(count(*) FILTER (cash) AS DOUBLE) AS cash,
         CAST(count(*) FILTER (debit AND amount > 1.5 * mean_debit) AS DOUBLE) AS large, coalesce(sum(amount) FILTER (debit), 0) AS debited, coalesce(sum(amount) FILTER (credit), 0) AS credited,
         coalesce(avg(amount) FILTER (debit), 0) AS mean_debited, coalesce(avg(amount) FILTER (credit), 0) AS mean_credited, count(*) FILTER (high_risk OR sensitive) AS risky, count(ts) AS timed, count(amount) AS amounts,
         CAST(count(*) FILTER (ts >= last - INTERVAL 5 MINUTE) AS DOUBLE) AS v5, CAST(count(*) FILTER (ts >= last - INTERVAL 1 HOUR) AS DOUBLE) AS v60, CAST(count(*) FILTER (ts >= last - INTERVAL 24 HOUR) AS DOUBLE) AS v1440
  FROM wide w JOIN cut USING (statement_id) GROUP BY 1),
f AS (
  SELECT statement_id, total_transactions, total_debits, total_credits, CASE WHEN total_credits > 0 THEN total_debits / total_credits ELSE total_debits END AS debit_credit_ratio,
         CASE WHEN days > 0 THEN total_transactions / days ELSE total_transactions END AS avg_txn_per_day, coalesce(mean, 0) AS avg_transaction_amount, coalesce(largest, 0) AS max_transaction, coalesce(least, 0) AS min_transaction,
         coalesce(std, 0) AS transaction_std_dev, coalesce(med, 0) AS median_transaction, high_value AS high_value_transactions, CASE WHEN coalesce(std, 0) > 0 THEN (largest - mean) / std ELSE 0 END AS max_amount_zscore,
         hr AS high_risk_merchants, legit AS legitimate_merchants, uniq AS unique_merchants, 1 - uniq / total_transactions AS merchant_concentration, rapid AS rapid_same_merchant_transactions, cash AS cash_like_activity,
         large AS large_debit_transactions, debited AS total_debited, credited AS total_credited, mean_debited AS avg_debit_amount, mean_credited AS avg_credit_amount, risky / total_transactions AS high_risk_merchant_ratio,
         CASE WHEN debited + credited > 0 THEN debited / (debited + credited) ELSE 0 END AS debit_amount_share, CASE WHEN timed >= 2 THEN v5 ELSE 0 END AS txn_velocity_5min, CASE WHEN timed >= 2 THEN v60 ELSE 0 END AS txn_velocity_1hour,
         CASE WHEN timed >= 2 THEN v1440 ELSE 0 END AS txn_velocity_24hour, CASE WHEN amounts >= 2 AND mean > 0 THEN largest / mean ELSE 0 END AS amount_spike_ratio, CASE WHEN amounts >= 2 AND med > 0 THEN largest / med ELSE 0 END AS max_to_median_ratio
  FROM a)"""

RULE_SQL = """greatest(0.0, least(100.0, 10 * high_risk_merchants + 75 * high_risk_merchant_ratio + large_debit_transactions + 5 * rapid_same_merchant_transactions + cash_like_activity
  + 8 * txn_velocity_5min + 2 * txn_velocity_1hour + CASE WHEN amount_spike_ratio > 20 THEN 0.5 * (amount_spike_ratio - 20) ELSE 0 END + 0.0001 * transaction_std_dev
  + CASE WHEN avg_txn_per_day > 15 THEN avg_txn_per_day - 15 ELSE 0 END + CASE WHEN max_amount_zscore > 3 THEN 2 * (max_amount_zscore - 3) ELSE 0 END - least(5 * legitimate_merchants, 30)))"""

TAKEOVER_SQL = f"""
late AS (
  SELECT *, row_number() OVER (PARTITION BY statement_id, (after AND type = 'debit') ORDER BY seq DESC) AS back FROM (
    SELECT *, coalesce(seq > min(CASE WHEN type = 'credit' THEN seq END) OVER (PARTITION BY statement_id), false) AS after,
           regexp_matches(lower(merchant), '{ANY(m.CASH_OUT)}') AS out, regexp_matches(lower(merchant), '{ANY(m.TRANSFERS)}') AS moved FROM tx)),
counts AS (
  SELECT statement_id, count(*) AS n, count(*) FILTER (after) AS rest, count(*) FILTER (after AND type = 'debit' AND out) AS outs, count(*) FILTER (after AND type = 'debit' AND moved) AS moves,
         count(*) FILTER (after AND type = 'debit' AND out AND back <= 3) AS recent FROM late GROUP BY 1),
taken AS (
  SELECT statement_id, CASE WHEN n < 4 OR rest < 3 THEN 0.0 WHEN moves >= 2 AND recent >= 2 THEN 90.0 WHEN outs >= 2 AND recent >= 2 THEN 75.0 WHEN outs >= 1 AND recent >= 1 AND moves >= 1 THEN 60.0 ELSE 0.0 END AS takeover_score FROM counts)"""

rounded = lambda df, names, n=4, shift=0.0: df.select(*[F.round(F.col(c) + shift, n).alias(c) if c in names else c for c in df.columns])
#: Added before means of amounts are rounded: exact halves, which engines round either way, become none.
SHIFT = 0.0000037
ROUNDED_FEATURES_SQL = ", ".join(f"round({f} + {SHIFT:.7f}, 4) AS {f}" for f in FEATURES)


def risk_features_events(spark, d):
    return rounded(features(event_transactions(spark, d)), FEATURES, shift=SHIFT)


def risk_features_orders(spark, d):
    return rounded(features(order_transactions(spark, d)), FEATURES, shift=SHIFT)


def risk_features_all_statements(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("statement_id"))
    return rounded(features(order_transactions(spark, d), statements=c), FEATURES, shift=SHIFT)


def risk_rule_score(spark, d):
    return features(event_transactions(spark, d)).select("statement_id", F.round(scoring.rule_score(), 4).alias("rule_score"))


def risk_takeover(spark, d):
    return scoring.takeover(order_transactions(spark, d))


def risk_verdict(spark, d):
    rows = analyse(order_transactions(spark, d))
    return rows.select("statement_id", F.round("rule_score", 4).alias("rule_score"), t.rounded(F.col("risk_score"), 3).alias("risk_score"), "is_fraud", "hybrid_level", "risk_level", "confidence", "verdict", "recommendation")


def risk_reasons(spark, d):
    rows = analyse(order_transactions(spark, d))
    return rows.select("statement_id", F.array_join("categories", ", ").alias("categories"), F.array_join("reasons", " / ").alias("reasons"))


def risk_key_metrics(spark, d):
    return analyse(event_transactions(spark, d)).select("statement_id", "key_metrics.*")


def hybrid_verdict_grid(spark, d):
    """The hybrid rule over all customers: the balance stands for the rule score, the key for the model's risk."""
    c = table(spark, d, "customer")
    v = scoring.verdict(F.col("c_acctbal") / 100, (F.col("c_custkey") % 101) / 100.0, F.col("c_custkey") % 7 == 0)
    return c.select("c_custkey", v.alias("v")).select("c_custkey", t.rounded(F.col("v.combined_score"), 3).alias("combined_score"), "v.is_fraud", "v.risk_level")


def band_tables(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 101).cast("double").alias("s"))
    return c.select("c_custkey", *[scoring.band(F.col("s") / (100 if k in ("detector", "inference") else 1), k).alias(k) for k in scoring.BANDS], scoring.dashboard_level(F.col("s"), F.lit("")).alias("dashboard"))


def calibration(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.round(scoring.calibrated((F.col("c_custkey") % 101) / 100.0), 6).alias("inference"), F.round(scoring.calibrated((F.col("c_custkey") % 101) / 100.0, 0.5), 6).alias("detector"))


def merchant_predicates(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 5 == 0, "bar").when(F.col("p_partkey") % 5 == 1, "Cryptobank").when(F.col("p_partkey") % 5 == 2, "batman rental")).alias("name"))
    c = F.col("name")
    return rows.select("p_partkey", m.is_high_risk(c).alias("high_risk"), m.is_sensitive(c).alias("sensitive"), m.is_legitimate(c).alias("legitimate"), m.is_cash_like(c).alias("cash_like"))


def statement_parse(spark, d):
    """Statement lines made of orders, parsed back."""
    o = spread(table(spark, d, "orders"))
    line = F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("  UPI DR INR "), F.format_number("o_totalprice", 2), F.lit(" Shop_"), F.col("o_custkey").cast("string"), F.lit(" ref"))
    dated = F.concat(F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" NEFT SALARY CREDIT "), F.format_string("%.2f", F.col("o_totalprice")), F.lit(" 999999999.99"))
    text = F.concat(F.lit("Opening balance 5.00\n\n"), line, F.lit("\nno date 12.00\n"), dated)
    return parse(o.select(F.col("o_orderkey").alias("statement_id"), text.alias("text")))


def document_signals(spark, d):
    return documents.signals(spread(table(spark, d, "documents")), "doc_id")


def document_statistics(spark, d):
    found = documents.statistics(table(spark, d, "documents"), "doc_id", pages=F.ceil(F.col("n_chars") / 3000))
    return found.withColumn("words_per_page", F.round("words_per_page", 4))


def document_compliance(spark, d):
    rows = documents.signals(table(spark, d, "documents"), "doc_id")
    return rows.groupBy(documents.compliance_band(F.col("account_count"), F.col("pan_count")).alias("band")).agg(F.count("*").alias("documents"))


def document_tidy(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(t.tidy_lines(F.col("text"))).alias("tidy_md5"))


def document_clean(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(t.clean(F.col("text"))).alias("clean_md5"))


def document_masks(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.format_string("PAN ABCDE%04dF account %010d end %06d", (F.col("c_custkey") % 10000).cast("int"), F.col("c_custkey") + 1000000000, (F.col("c_custkey") + 100000).cast("int")).alias("text"))
    return rows.select("c_custkey", t.mask_sensitive(F.col("text")).alias("masked"))


def amount_formats(spark, d):
    return table(spark, d, "orders").select("o_orderkey", t.format_amount(F.floor(F.col("o_totalprice") / F.pow(F.lit(10.0), F.col("o_orderkey") % 5)).cast("double")).alias("shown"))


def section_titles(spark, d):
    """Titles of turns behind tabs, line ends of other systems and rare white space."""
    lead = F.when(F.col("turn") % 5 == 0, "\t# ").when(F.col("turn") % 5 == 1, "\u00a0\u200912. ").when(F.col("turn") % 5 == 2, "TOTAL SUMS:\r\n").otherwise("")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, "intro\n").otherwise(""), lead, F.col("text"), F.lit("\r")).alias("text"))
    return c.select("conv_id", "turn", t.section_title(F.col("text")).alias("title"))


def page_range_join(spark, d):
    """Lines of an order as pages of its quantity in characters; positions from the line number."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number")).agg(F.max("l_quantity").cast("int").alias("n"))
    spans = documents.page_spans(li.select("document_id", "page_number", F.repeat(F.lit("x"), F.col("n")).alias("text")))
    where = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 90).cast("int").alias("position"))
    return documents.page_of(where, spans)


def chunks(spark, d):
    found = retrieval.chunk_documents(spread(table(spark, d, "documents")), 500, 200, key="doc_id")
    return found.select("doc_id", "chunk_id", "position", "page_number", "page_by_offset", "section_title", F.md5("content").alias("content_md5"), "word_count", "char_count")


def chunk_statistics(spark, d):
    return retrieval.chunk_statistics(retrieval.chunk_documents(spread(table(spark, d, "documents")), key="doc_id"), "doc_id")


def asked(spark, d):
    e = table(spark, d, "embeddings")
    vectors = e.select(F.col("label").alias("document_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    return e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("document_id"), F.col("embedding").alias("q")), vectors


def vector_search(spark, d):
    queries, vectors = asked(spark, d)
    return retrieval.search(queries, vectors, 10).withColumn("similarity", F.round("similarity", 5))


def vector_threshold(spark, d):
    queries, vectors = asked(spark, d)
    return retrieval.above_threshold(retrieval.search(queries, vectors, 10), 0.9).select("query_id", "chunk_id", "vector_rank")


def hits(spark, d):
    queries, vectors = asked(spark, d)
    content = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " revenue profit index").otherwise(" Copyright footer")).alias("content"), F.concat(F.lit("Risk "), F.col("source")).alias("section_title"), F.col("lang"))
    return retrieval.search(queries, vectors, 10).join(content, "chunk_id").withColumn("query", F.lit("risk"))


def rerank(spark, d):
    best = retrieval.rerank(hits(spark, d), 5)
    return best.select("query_id", "chunk_id", F.round("rerank_score", 5).alias("rerank_score"), F.round("final_score", 4).alias("final_score"), "rank")


def ranking_metrics(spark, d):
    rows = retrieval.search(*asked(spark, d), 10).select("query_id", F.col("vector_rank").alias("rank"), (F.col("chunk_id") % 4 == 0).alias("relevant"))
    found = retrieval.ranking_metrics(rows)
    return rounded(found, ["mrr", "ndcg", "ndcg_log2", "precision"], 6)


def answer_prompts(spark, d):
    best = retrieval.rerank(hits(spark, d), 5).withColumn("page_number", (F.col("chunk_id") % 3).cast("int"))
    asked_for = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("risk").alias("query"), F.concat(F.lit("doc_"), F.col("label").cast("string")).alias("document_name"))
    return answers.prompts(asked_for, best).select("query_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def answer_parse(spark, d):
    """Answers in the format that prompts ask for, with bullets; without; with two marks a line; begun anew; and without any mark."""
    c = table(spark, d, "conversations")
    body, kind = F.coalesce("text", F.lit("")), F.col("turn") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("Well.\n- **Answer:** "), body, F.lit("\r\n\n\t more \u00a0\n- **Confidence:** HIGH\n- **Source:** Section 1\n")))
        .when(kind == 1, F.concat(F.lit("**Source:** lost\n**Answer:** old\n"), body, F.lit("\n**Source:** a **Answer:** "), body, F.lit("\n**Context:**\n"), body))
        .when(kind == 2, F.concat(F.lit(answers.MOCK_ANSWER + "\n"), body))
        .when(kind == 3, F.concat(body, F.lit("\n* **Context:** one\n**Context:** two **Confidence:** LOW\nlast **Confidence:**")))
        .otherwise(body)
    )
    return c.select("conv_id", "turn", answers.parsed(text).alias("p")).select("conv_id", "turn", "p.*")


def risk_text_report(spark, d):
    rows = analyse(order_transactions(spark, d)).withColumn("report_id", explain.report_id(F.concat(F.lit("customer "), F.col("statement_id").cast("string"), F.lit(".pdf")), F.lit("20260101"))).withColumn("generated", F.lit("2026-01-01"))
    rows = rows.withColumn("document_name", F.concat(F.col("statement_id").cast("string"), F.lit(".pdf")))
    return rows.select("statement_id", answers.text_report().alias("report"), answers.summary_report().alias("summary"), answers.offline_summary(t.rounded(F.col("risk_score"), 2), F.col("is_fraud"), F.col("reasons")).alias("offline"))


def model_compare(spark, d):
    """All four models with their presets over all features of users' statements."""
    f = features(event_transactions(spark, d)).withColumn("label", (F.col("total_debits") > F.lit(53)).cast("int"))
    return training.compare(f, FEATURES, "statement_id")


def model_learning_curve(spark, d):
    f = features(order_transactions(spark, d)).withColumn("label", (F.col("max_transaction") > F.lit(400000)).cast("int"))
    return training.learning_curve(f, ["total_transactions", "avg_transaction_amount"], "statement_id")


def embedding_cache(spark, d):
    """Vectors of all documents' texts per source; a third is in the cache, of which a part is of another model and so is computed."""
    docs = table(spark, d, "documents").select(F.col("source").alias("document_id"), "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    names = docs.select("document_id", F.when(F.col("doc_id") % 7 == 0, "other").otherwise("hashed").alias("model"), F.md5("content").alias("md5"), "doc_id").where("doc_id % 3 = 0")
    cache = names.groupBy("document_id", "model", "md5").agg(F.array(F.lit(0.0).cast("float")).alias("vector"))
    found = retrieval.embed_missing(docs.select("document_id", "content"), cache, retrieval.embed(8))
    return found.select("document_id", "md5", "cached", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def history_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return history.latest(rows, ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def history_insert(spark, d):
    o = table(spark, d, "orders").select("o_custkey")
    stored = o.where("o_custkey % 3 = 0").distinct()
    new, there = history.insert_unique(stored, o, "o_custkey")
    return new.withColumn("state", F.lit("inserted")).unionByName(there.withColumn("state", F.lit("conflict")))


def history_visible(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("owner"))
    return history.visible(o, "owner", 7, False, unknown=True)


def reports(spark, d):
    o = table(spark, d, "orders")
    score = (F.col("o_orderkey") % 101).cast("double")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("statement_"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("name"), score.alias("risk_score"), scoring.band(score, "report").alias("risk_level"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") + F.expr("interval 3 days")).alias("updated_at"))


def report_search(spark, d):
    return history.search(reports(spark, d), ["name", "risk_level", "id"], "STATEMENT_1", "HIGH").select("id", "name", "risk_score")


def report_newest(spark, d):
    return history.newest(reports(spark, d)).select("id", "label", "risk_score")


def report_levels(spark, d):
    return history.level_counts(reports(spark, d))


def report_flags(spark, d):
    return history.flagged(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "has_orders")


def model_metrics(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).cast("int").alias("label"), (F.col("l_extendedprice") > 50000).cast("int").alias("predicted"))
    return rounded(learning.classification_metrics(rows, "label", "predicted", ["l_returnflag"]), ["accuracy", "precision", "recall", "f1"], 6)


def model_areas(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("label"), F.floor(F.col("l_extendedprice") / 1000).alias("score"))
    return rounded(learning.areas(rows, "label", "score"), ["roc_auc", "average_precision"], 6)


def model_curves(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("label"), F.floor(F.col("l_extendedprice") / 1000).alias("score"))
    return rounded(learning.curves(rows, "label", "score"), ["tpr", "fpr", "precision"], 6)


def model_histogram(spark, d):
    return rounded(learning.histogram(table(spark, d, "orders"), "o_totalprice"), ["density"], 10)


def model_standardise(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(3.0).alias("same"))
    return rounded(learning.standardise(rows, ["c_acctbal", "same"]), ["c_acctbal", "same"], 5)


def model_impute(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return learning.impute_median(rows, ["c_acctbal"])


def model_profile(spark, d):
    return rounded(learning.amount_profile(table(spark, d, "orders"), "o_totalprice"), ["median", "p90", "spread"], 3)


def model_split(spark, d):
    rows = learning.stratified_split(table(spark, d, "labels").where("quality is not null"), "quality", "doc_id")
    return rows.select("doc_id", "quality", "is_test")


def model_rank(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("auc"), F.count("*").alias("n"))
    return history.running_rank(rows, ["n", "auc", "p_brand"]).select("p_brand", "n", "rank")


def anomaly_forest(spark, d):
    """The detector with its presets: all features, 200 trees."""
    rows = storage.written(features(order_transactions(spark, d)), "features")
    return prediction.predict(rows, prediction.fit(rows, FEATURES, "statement_id"))


#: A detector small enough for SQL: two trees of one and two cuts over five scaled features, so that the thirty are cut to five.
SMALL_DETECTOR = prediction.Detector(
    FEATURES[:5], [10.0, 8.0, 2.0, 4.0, 1.0], [5.0, 4.0, 1.0, 2.0, 1.0],
    [
        {"tree": 0, "n": 8, "feature": [0, -1, -1], "cut": [0.5, 0.0, 0.0], "low": [1, -1, -1], "high": [2, -1, -1], "depth": [0.0, 4.0, 1.0]},
        {"tree": 1, "n": 8, "feature": [3, -1, 2, -1, -1], "cut": [-1.0, 0.0, 0.25, 0.0, 0.0], "low": [1, -1, 3, -1, -1], "high": [2, -1, 4, -1, -1], "depth": [0.0, 1.0, 0.0, 5.0, 2.0]},
    ],
    0.6,
)


def predict_batch(spark, d):
    found = prediction.predict(features(order_transactions(spark, d)), SMALL_DETECTOR)
    return rounded(found.withColumn("model", prediction.metadata(SMALL_DETECTOR, "small")).select("statement_id", "anomaly_score", "risk_score", "is_fraud", "risk_level", "model.*"), ["anomaly_score", "risk_score"], 6)


def retrieval_evaluation(spark, d):
    """Searches as test cases of their label's keywords, against the ten chunks found; one case in three hundred has no results."""
    found = hits(spark, d).select(F.col("query_id").alias("case_id"), F.col("vector_rank").alias("rank"), "content", (F.col("query_id") % 7).cast("double").alias("latency_ms"))
    cases = table(spark, d, "embeddings").where("vec_id % 50 = 0 OR vec_id % 300 = 1").select(F.col("vec_id").alias("case_id"), F.when(F.col("label") % 2 == 0, F.array(F.lit("Profit"), F.lit("never"))).otherwise(F.array(F.lit("COPYRIGHT"))).alias("keywords"))
    return rounded(evaluation.evaluate(cases, found), ["mrr", "ndcg", "p_at_5"], 6)


def retrieval_summary(spark, d):
    found = retrieval_evaluation(spark, d)
    return rounded(evaluation.summary(found), ["success_rate", "mean_reciprocal_rank", "mean_ndcg", "mean_precision_at_5", "mean_latency_ms"], 4, shift=SHIFT)


def index_cycle(spark, d):
    """Turns of conversations, each with a vector of the table of vectors, as an index: written, one part replaced, one deleted, then what is there of all conversations."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), ((F.col("conv_id") * 8 + F.col("turn")) % 500).alias("vec_id"))
    c = c.join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id", "left").drop("vec_id")
    path = storage.work_path(spark, "index")
    readers.write_index(c, path)
    readers.write_index(c.where("document_id % 5 = 1").withColumn("content", F.concat(F.lit("new "), F.col("content"))), path)
    readers.delete_documents(spark, path, c.where("document_id % 5 = 2").select("document_id"))
    ids = c.select("document_id").distinct()
    stats = readers.index_stats(spark, path, ids)
    norm = readers.read_index(spark, path).groupBy("document_id").agg(F.round(F.max(F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)")), 6).alias("norm"), F.round(F.sum(F.col("embedding")[0] - F.col("embedding")[1]), 5).alias("mark"))
    return readers.document_exists(spark, path, ids).join(stats, "document_id").join(norm, "document_id", "left").select("document_id", "exists", "chunks", "chars", "words", F.round("mean_chars", 4).alias("mean_chars"), "norm", "mark")


def model_profile_columns(spark, d):
    o = table(spark, d, "orders")
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") * 40).alias("Amount"))
    return rounded(learning.with_profile(rows, learning.amount_profile(o, "o_totalprice")), ["pdf_amount_zscore"], 5)


def label_share(spark, d):
    rows = table(spark, d, "labels").where("quality is not null")
    return rounded(learning.label_mean(rows, "quality"), ["share"], 6)


def model_best(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return learning.best_by(rows, "p_brand", "n")


def report_order(spark, d):
    """Places of all reports in the orders by score, name and date."""
    rows = reports(spark, d)
    found = None
    for by, descending in (("score", True), ("name", False), ("date", True)):
        part = history.placed(rows, by, descending).select(F.lit(by).alias("sorted_by"), "place", "id", "name", "risk_score")
        found = part if found is None else found.unionByName(part)
    return found


def report_metadata(spark, d):
    """Reports with their document, named in JSON, of which the first by size and path counts."""
    rows = reports(spark, d).withColumn("response", F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("c"), F.col("id") % 500).alias("id")).alias("storage_ref")).alias("data"))))
    rows = rows.withColumn("document_id", readers.json_value("response", "$.data.storage_ref.id"))
    docs = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey") % 400).alias("document_id"), (F.col("c_custkey") * 977).alias("size"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("/f/"), F.col("c_custkey").cast("string"))).alias("file_path"), F.when(F.col("c_custkey") % 4 != 0, F.md5(F.col("c_custkey").cast("string"))).alias("blob_id"), F.col("c_name").alias("doc_name"))
    found = history.with_metadata(rows.select("id", "document_id"), docs, "document_id")
    shown = history.document_list(found.withColumnRenamed("doc_name", "name"))
    return shown.select("id", "name", "size", "has_pdf", "has_blob")


def type_totals(spark, d):
    return rounded(history.type_totals(order_transactions(spark, d)), ["total_debit", "total_credit"], 2)


def first_transactions(spark, d):
    rows = history.first_transactions(event_transactions(spark, d))
    return rows.select("statement_id", "seq", "type", F.round("amount", 4).alias("amount"))


def report_accuracy(spark, d):
    return reports(spark, d).groupBy("risk_level").agg(history.accuracy(F.col("risk_score")).alias("accuracy"))


def reasons_with_takeover(spark, d):
    """Reasons with the take-over's at the head unless it is among them, and the first five."""
    rows = analyse(order_transactions(spark, d))
    taken = explain.takeover_reason(F.col("takeover_score"))
    every = F.when(taken != "", history.prepend_missing(F.col("reasons"), taken)).otherwise(F.col("reasons"))
    return rows.select("statement_id", F.get(every, F.lit(0)).alias("head"), F.size(every).cast("long").alias("n"), F.size(F.slice(every, 1, 5)).cast("long").alias("shown"))


def file_names(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat(F.col("p_name"), F.lit(" (v."), F.col("p_partkey").cast("string"), F.lit(").final.pdf"))).alias("name"), (F.col("p_partkey") * F.col("p_partkey") * 37 - 37).alias("size"))
    return rows.select("p_partkey", t.file_base_name(F.col("name")).alias("base"), t.format_bytes(F.col("size")).alias("bytes"), t.format_money(F.col("size") / 8).alias("money"), t.format_percent((F.col("p_partkey") % 64) / 64.0).alias("percent"), F.length(t.preview(F.repeat("name", F.lit(30)))).alias("preview"))


def report_prompts(spark, d):
    rows = analyse(order_transactions(spark, d)).withColumn("document_name", F.concat(F.col("statement_id").cast("string"), F.lit(".pdf"))).withColumn("_s", F.floor("risk_score").cast("long"))
    return rows.select("statement_id", F.md5(answers.advice_prompt(F.col("_s"))).alias("advice"), answers.summary_prompt(F.col("_s")).alias("summary"))


def transactions_appended(spark, d):
    """Statements of two sources as one list, numbered on."""
    return transactions_of_both(spark, d).groupBy("statement_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def transactions_of_both(spark, d):
    from ledgerlens.operators.transactions import appended

    events = event_transactions(spark, d).select("statement_id", "seq", "date", "amount", "type", "merchant")
    return appended([events, order_transactions(spark, d).select("statement_id", "seq", "date", "amount", "type", "merchant")])


def event_velocity(spark, d):
    return velocity(table(spark, d, "events")).select("user_id", F.col("window_start").cast("string").alias("window_start"), "n", F.round("amount", 4).alias("amount"))


QUERIES = {
    q.__name__: q
    for q in (
        risk_verdict, risk_features_events, risk_features_orders, risk_features_all_statements, risk_rule_score, risk_takeover, risk_reasons, risk_key_metrics, hybrid_verdict_grid, band_tables, calibration,
        merchant_predicates, statement_parse, document_signals, document_statistics, document_compliance, document_tidy, document_clean, document_masks, amount_formats, section_titles, page_range_join, chunks, chunk_statistics,
        vector_search, vector_threshold, rerank, ranking_metrics, embedding_cache, history_latest, history_insert, history_visible, report_search, report_newest, report_levels, report_flags,
        model_metrics, model_areas, model_curves, model_histogram, model_standardise, model_impute, model_profile, model_split, model_rank, anomaly_forest, event_velocity, answer_prompts, answer_parse, risk_text_report, model_compare, model_learning_curve,
        predict_batch, retrieval_evaluation, retrieval_summary, index_cycle, model_profile_columns, label_share, model_best, report_order, report_metadata, type_totals, first_transactions, report_accuracy, reasons_with_takeover,
        file_names, report_prompts, transactions_appended,
    )
}


def _features(source: str, more: str = "") -> str:
    return f"WITH tx AS ({source}), {FEATURES_SQL}{more} "


_COMBINED = "round(0.2 * rule_score, 4)"
_ANALYSED = _features(ORDERS_SQL, f""",
{TAKEOVER_SQL},
v AS (
  SELECT f.*, takeover_score, rule_score, {_COMBINED} AS c, greatest({_COMBINED}, takeover_score) AS risk_score,
         (rule_score >= 75 OR takeover_score >= 70) AS is_fraud
  FROM (SELECT *, {RULE_SQL} AS rule_score FROM f) f JOIN taken USING (statement_id))""")
_ADVICE = {k: v.replace("'", "''") for k, v in explain.ADVICE.items()}
_MONEY = lambda x: f"CASE WHEN {x} >= 100000 THEN '$' || CAST(floor({x} / 1000 + 0.5) AS BIGINT) || 'K' WHEN {x} >= 1000 THEN '$' || printf('%,d', CAST(round({x}) AS BIGINT)) ELSE '$' || printf('%.2f', {x}) END"
_UNIT = "list_transform({0}, lambda x: x / (sqrt(list_sum(list_transform({0}, lambda y: CAST(y AS DOUBLE) * y))) + 1e-10))"
_NEAR = f"""
u AS (SELECT vec_id, label, {_UNIT.format('CAST(embedding AS DOUBLE[])')} AS v FROM embeddings),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_sum(list_transform(list_zip(c.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM u q JOIN u c USING (label) WHERE q.vec_id % 50 = 0),
hits AS (SELECT * FROM (SELECT query_id, chunk_id, 1 / (1 + d) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS vector_rank FROM near) WHERE vector_rank <= 10)"""
_LABELLED = "SELECT l_quantity > 25 AS yes, floor(l_extendedprice / 1000) AS score FROM lineitem"
_STEPS = f"""
s AS ({_LABELLED}), per AS (SELECT score, count(*) FILTER (yes) AS pos, count(*) FILTER (NOT yes) AS neg FROM s GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM per), tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM per)"""
_RE = lambda name: t.PATTERNS[name].replace("(?i)", "").replace("'", "''")
_COUNT = lambda name: f"CAST(len(regexp_extract_all(coalesce(text, ''), '{_RE(name)}'{', 0, ' + chr(39) + 'i' + chr(39) if t.PATTERNS[name].startswith('(?i)') else ''})) AS INTEGER)"
_REPORTS = """r AS (SELECT o_orderkey AS id, 'statement_' || o_custkey || '.pdf' AS name, CAST(o_orderkey % 101 AS DOUBLE) AS risk_score, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 101 >= 70 THEN 'HIGH' WHEN o_orderkey % 101 >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 3 DAY END AS updated_at FROM orders)"""
_LINES = "regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))"


def _band(x: str, name: str) -> str:
    low, high, names = scoring.BANDS[name]
    return f"CASE WHEN {x} >= {high} THEN '{names[2]}' WHEN {x} >= {low} THEN '{names[1]}' ELSE '{names[0]}' END"


_GRID = """SELECT c_custkey, f, a, flag, round(0.2 * f + 0.8 * 100 * a, 4) AS c FROM (
  SELECT c_custkey, greatest(0, least(100, c_acctbal / 100)) AS f, (c_custkey % 101) / 100.0::DOUBLE AS a, c_custkey % 7 = 0 AS flag FROM customer)"""

_TEXT = lambda x: " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in x.split("\n"))
#: What Python's strip() takes off.
_WHITE = " || ".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace())
_BYTES = lambda x: f"CASE WHEN coalesce({x}, 0) = 0 THEN '--' WHEN {x} < 1024 THEN {x} || ' B' WHEN {x} < 1048576 THEN printf('%.1f', round({x} / 1024, 1)) || ' KB' ELSE printf('%.1f', round({x} / 1048576, 1)) || ' MB' END"
_THICK, _THIN = "=" * 70, "-" * 70
_TITLE = lambda x: f"'{_THIN}' || chr(10) || '{x}' || chr(10) || '{_THIN}'"
#: Everything that is said of a statement: level, recommendation and all reasons in their order.
_EXPLAINED = _ANALYSED + f""",
cats AS (SELECT statement_id, string_agg(DISTINCT c, ', ' ORDER BY c) AS categories FROM (
  SELECT statement_id, unnest(list_filter([{", ".join(f"CASE WHEN contains(lower(merchant), '{k}') THEN '{c}' END" for k, c in m.CATEGORIES)}], lambda x: x IS NOT NULL)) AS c FROM tx) GROUP BY 1),
n AS (SELECT v.*, coalesce(categories, '') AS categories FROM v LEFT JOIN cats USING (statement_id)),
found AS (SELECT *, list_filter([
  CASE WHEN high_risk_merchants >= 1 AND categories <> '' THEN 'Transactions with high-risk merchants detected: ' || categories
       WHEN high_risk_merchants > 1 THEN 'Multiple transactions with gambling, casino, or crypto merchants' WHEN high_risk_merchants >= 1 THEN 'A transaction with gambling, casino, or crypto merchants' END,
  CASE WHEN takeover_score = 90 THEN '{explain.TAKEOVER[90.0]}' WHEN takeover_score = 75 THEN '{explain.TAKEOVER[75.0]}' END,
  CASE WHEN high_risk_merchant_ratio >= 0.5 AND high_risk_merchants < 1 THEN 'Sustained trading or crypto activity detected; pattern is consistent but still warrants monitoring' END,
  CASE WHEN large_debit_transactions >= 1 THEN 'Unusually large withdrawal amount detected (up to ' || {_MONEY('max_transaction')} || ')' END,
  CASE WHEN rapid_same_merchant_transactions >= 2 THEN 'Multiple rapid transactions to the same merchant within short time window' END,
  CASE WHEN txn_velocity_5min >= 1 THEN 'Extremely high transaction velocity: ' || CAST(txn_velocity_5min AS INT) || ' transactions within 5 minutes' END,
  CASE WHEN txn_velocity_1hour >= 3 THEN 'High transaction frequency: ' || CAST(txn_velocity_1hour AS INT) || ' transactions within 1 hour' END,
  CASE WHEN amount_spike_ratio >= 5 THEN 'Abnormal spending spike detected (' || printf('%.1f', amount_spike_ratio) || 'x above average)' END,
  CASE WHEN high_value_transactions >= 3 THEN 'Multiple high-value transactions detected (' || CAST(high_value_transactions AS INT) || ')' END,
  CASE WHEN avg_txn_per_day >= 10 THEN 'Unusually high transaction frequency (' || printf('%.1f', avg_txn_per_day) || ' transactions per day)' END,
  CASE WHEN cash_like_activity >= 2 THEN 'Multiple ATM or cash-equivalent transactions detected' END,
  CASE WHEN transaction_std_dev >= 20000 THEN 'High variation in transaction amounts (inconsistent spending pattern)' END,
  CASE WHEN max_amount_zscore >= 3 THEN 'Transaction amount significantly deviates from normal pattern (z-score: ' || printf('%.1f', max_amount_zscore) || ')' END], lambda x: x IS NOT NULL) AS given FROM n),
told AS (SELECT *, CASE WHEN len(given) > 0 THEN given ELSE ['{explain.FALLBACK}'] END AS reasons, {_band('risk_score', 'report')} AS risk_level,
  CASE WHEN is_fraud AND risk_score >= 70 THEN '{_ADVICE["urgent"]}' WHEN is_fraud AND risk_score >= 45 THEN '{_ADVICE["review"]}' WHEN risk_score >= 45 THEN '{_ADVICE["enhanced"]}'
       WHEN risk_score >= 35 THEN '{_ADVICE["standard"]}' ELSE '{_ADVICE["none"]}' END AS recommendation FROM found)
"""
_EVALUATED = f"""WITH {_NEAR},
cases AS (SELECT vec_id AS case_id, label % 2 = 0 AS even FROM embeddings WHERE vec_id % 50 = 0 OR vec_id % 300 = 1),
res AS (SELECT query_id, vector_rank AS k, lower(text || CASE WHEN doc_id % 3 = 0 THEN ' revenue profit index' ELSE ' Copyright footer' END) AS low FROM hits JOIN documents ON doc_id = chunk_id),
rel AS (SELECT case_id, k, coalesce(CASE WHEN even THEN contains(low, 'profit') OR contains(low, 'never') ELSE contains(low, 'copyright') END, false) AS r FROM cases JOIN res ON query_id = case_id),
per AS (SELECT case_id, count(*) AS n, count(*) FILTER (r) AS good, coalesce(1.0 / min(k) FILTER (r), 0) AS mrr, sum(CASE WHEN r THEN 1 / sqrt(k) ELSE 0 END) FILTER (k <= 5) / sum(1 / sqrt(k)) FILTER (k <= 5) AS ndcg, avg(CAST(r AS INT)) FILTER (k <= 5) AS p FROM rel GROUP BY 1),
evaluated AS (SELECT case_id, coalesce(n, 0) AS retrieved_chunks, coalesce(good, 0) AS relevant_chunks, round(coalesce(mrr, 0), 6) AS mrr, round(coalesce(ndcg, 0), 6) AS ndcg, round(coalesce(p, 0), 6) AS p_at_5,
  CAST(CASE WHEN n IS NULL THEN 0 ELSE case_id % 7 END AS DOUBLE) AS latency_ms, coalesce(good, 0) > 0 AS success FROM cases LEFT JOIN per USING (case_id))
"""
_RANKED = f"""WITH {_NEAR},
c AS (SELECT hits.*, source, text || CASE WHEN doc_id % 3 = 0 THEN ' revenue profit index' ELSE ' Copyright footer' END AS body FROM hits JOIN documents ON doc_id = chunk_id),
k AS (SELECT *, len(list_filter({retrieval.FINANCIAL}, lambda w: contains(lower(body), w))) AS fin, len(list_filter({retrieval.BOILERPLATE}, lambda w: contains(lower(body), w))) AS boiler, len(regexp_extract_all(body, '\\S+')) AS words FROM c),
z AS (SELECT *, 0.7 * similarity + 0.3 * greatest(0.0, least(1.0, (0.5 + least(fin * 0.05, 0.2) - least(boiler * 0.1, 0.3) + 0.15) * CASE WHEN words < 20 THEN 0.8 ELSE 1.0 END)) AS fs FROM k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, vector_rank) AS rank FROM z)"""

ORACLE_SQL = {
    "risk_features_events": _features(EVENTS_SQL) + f"SELECT statement_id, {ROUNDED_FEATURES_SQL} FROM f",
    "risk_features_orders": _features(ORDERS_SQL) + f"SELECT statement_id, {ROUNDED_FEATURES_SQL} FROM f",
    "risk_features_all_statements": _features(ORDERS_SQL) + "SELECT c_custkey AS statement_id, " + ", ".join(f"round(coalesce({f}, 0) + {SHIFT:.7f}, 4) AS {f}" for f in FEATURES) + " FROM customer LEFT JOIN f ON c_custkey = statement_id",
    "risk_rule_score": _features(EVENTS_SQL) + f"SELECT statement_id, round({RULE_SQL}, 4) AS rule_score FROM f",
    "risk_takeover": f"WITH tx AS ({ORDERS_SQL}), {TAKEOVER_SQL} SELECT statement_id, CAST(takeover_score AS DOUBLE) AS takeover_score FROM taken",
    "risk_verdict": _ANALYSED + f"""
SELECT statement_id, round(rule_score, 4) AS rule_score, round(risk_score, 3) AS risk_score, is_fraud,
       CASE WHEN c >= 70 OR rule_score >= 75 THEN 'high' WHEN c >= 50 OR rule_score >= 50 THEN 'medium' ELSE 'low' END AS hybrid_level, {_band('risk_score', 'report')} AS risk_level, {_band('risk_score', 'confidence')} AS confidence,
       CASE WHEN is_fraud AND risk_score >= 70 THEN 'HIGH RISK - Fraudulent activity strongly suspected' WHEN is_fraud THEN 'MEDIUM RISK - Suspicious activity detected'
            WHEN risk_score >= 45 THEN 'MEDIUM RISK - Some unusual patterns detected' ELSE 'LOW RISK - Activity appears normal' END AS verdict,
       CASE WHEN is_fraud AND risk_score >= 70 THEN '{_ADVICE["urgent"]}' WHEN is_fraud AND risk_score >= 45 THEN '{_ADVICE["review"]}' WHEN risk_score >= 45 THEN '{_ADVICE["enhanced"]}'
            WHEN risk_score >= 35 THEN '{_ADVICE["standard"]}' ELSE '{_ADVICE["none"]}' END AS recommendation
FROM v""",
    "risk_reasons": _EXPLAINED + "SELECT statement_id, categories, array_to_string(reasons, ' / ') AS reasons FROM told",
    "reasons_with_takeover": _EXPLAINED + f"""
SELECT statement_id, CASE WHEN takeover_score = 60 THEN '{explain.TAKEOVER[60.0]}' ELSE reasons[1] END AS head, CAST(len(reasons) + CAST(takeover_score = 60 AS INT) AS BIGINT) AS n,
       CAST(least(5, len(reasons) + CAST(takeover_score = 60 AS INT)) AS BIGINT) AS shown FROM told""",
    "risk_text_report": _EXPLAINED + f"""
SELECT statement_id, array_to_string(['{_THICK}' || chr(10) || 'FINANCIAL RISK COMPLIANCE REPORT' || chr(10) || '{_THICK}' || chr(10), 'Report ID: RISK_REPORT_customer' || statement_id || 'pdf_20260101', 'Generated: 2026-01-01', 'Document: ' || statement_id || '.pdf' || chr(10),
  {_TITLE('RISK ASSESSMENT')}, 'Risk Level: ' || risk_level || ' (' || CAST(round(risk_score, 2) AS VARCHAR) || '/100)', 'ML Anomaly Score: 0.0',
  'Fraud Verdict: ' || CASE WHEN is_fraud THEN 'YES - Fraudulent activity detected' ELSE 'NO - Activity within normal range' END || chr(10),
  {_TITLE('DETECTED ISSUES')}, array_to_string(list_transform(reasons, lambda r, i: i || '. ' || r), chr(10)) || chr(10), {_TITLE('KEY TRANSACTION METRICS')},
  'Total Transactions: ' || CAST(total_transactions AS INT), 'Total Debited: $' || format('{{:,.2f}}', round(total_debited, 2)), 'Total Credited: $' || format('{{:,.2f}}', round(total_credited, 2)), 'High-Risk Merchants: ' || CAST(high_risk_merchants AS INT),
  'Max Transaction: $' || format('{{:,.2f}}', round(max_transaction, 2)), 'Unique Merchants: ' || CAST(unique_merchants AS INT), 'Rapid Transactions (5min): ' || CAST(greatest(txn_velocity_5min, rapid_same_merchant_transactions) AS INT),
  'Large Debits: ' || CAST(large_debit_transactions AS INT) || chr(10), {_TITLE('RECOMMENDATION')}, recommendation || chr(10), '{_THICK}' || chr(10) || 'END OF REPORT' || chr(10) || '{_THICK}'], chr(10)) AS report,
  CASE risk_level WHEN 'HIGH' THEN '🔴' WHEN 'MEDIUM' THEN '🟡' ELSE '🟢' END || ' ' || risk_level || ' Risk Score: ' || CAST(round(risk_score, 2) AS VARCHAR) || '/100 | Document: ' || statement_id || '.pdf | Issues: ' || array_to_string(reasons[1:3], ', ')
  || CASE WHEN len(reasons) > 3 THEN ' (+' || (len(reasons) - 3) || ' more)' ELSE '' END || ' | Action: '
  || CASE {" ".join(f"WHEN contains(recommendation, '{k}') THEN '{v}'" for k, v in answers.ACTIONS)} ELSE 'No immediate action required' END AS summary,
  'This analysis identified a risk score of ' || CAST(round(risk_score, 2) AS VARCHAR) || '/100 with ' || CASE WHEN is_fraud THEN 'fraudulent activity detected' ELSE 'no fraud detected' END || '. ' || len(reasons) || ' suspicious patterns were flagged. '
  || CASE WHEN is_fraud THEN 'Immediate manual review is recommended.' ELSE 'Standard monitoring procedures apply.' END AS offline FROM told""",
    "report_prompts": _EXPLAINED + f"""
SELECT statement_id, md5('Based on this fraud analysis:' || chr(10) || chr(10) || '- Risk Score: ' || CAST(floor(risk_score) AS BIGINT) || '/100' || chr(10) || '- Risk Band: ' || {_band('floor(risk_score)', 'prompt')} || chr(10) || '- Fraud Detected: ' || CASE WHEN is_fraud THEN 'YES' ELSE 'NO' END || chr(10)
  || '- Flagged Issues: ' || len(reasons) || chr(10) || chr(10) || 'Issues:' || chr(10) || array_to_string(list_transform(reasons[1:5], lambda r: '- ' || r), chr(10)) || chr(10) || chr(10) || {_TEXT(answers.ADVICE_TASK)}) AS advice,
  'Analyze this financial document fraud assessment:' || chr(10) || chr(10) || '**Document:** ' || statement_id || '.pdf' || chr(10) || '**Risk Score:** ' || CAST(floor(risk_score) AS BIGINT) || '/100' || chr(10) || '**Fraud Verdict:** ' || CASE WHEN is_fraud THEN 'FRAUDULENT ACTIVITY DETECTED' ELSE 'No fraud detected' END || chr(10) || chr(10)
  || '**Transaction Metrics:**' || chr(10) || '- Total Transactions: ' || CAST(total_transactions AS INT) || chr(10) || '- Total Debited: $' || format('{{:,.2f}}', round(total_debited, 2)) || chr(10) || '- Total Credited: $' || format('{{:,.2f}}', round(total_credited, 2)) || chr(10)
  || '- High-Risk Merchants: ' || CAST(high_risk_merchants AS INT) || chr(10) || '- Max Transaction: $' || format('{{:,.2f}}', round(max_transaction, 2)) || chr(10) || '- Rapid Transactions: ' || CAST(greatest(txn_velocity_5min, rapid_same_merchant_transactions) AS INT) || chr(10) || chr(10)
  || '**Detected Issues:**' || chr(10) || array_to_string(list_transform(reasons[1:10], lambda r, i: i || '. ' || r), chr(10)) || chr(10) || chr(10) || {_TEXT(answers.SUMMARY_TASK)} AS summary FROM told""",
    "predict_batch": _features(ORDERS_SQL) + f""", x AS (SELECT statement_id, (total_transactions - 10) / 5 AS x0, total_credits - 2 AS x2, (debit_credit_ratio - 4) / 2 AS x3 FROM f),
p AS (SELECT statement_id, pow(2.0, -((CASE WHEN x0 < 0.5 THEN 4.0 ELSE 1.0 END + CASE WHEN x3 < -1 THEN 1.0 WHEN x2 < 0.25 THEN 5.0 ELSE 2.0 END) / 2) / (2 * (ln(7.0::DOUBLE) + {learning.EULER}) - 14.0 / 8)) AS a FROM x),
q AS (SELECT *, 1 / (1 + exp(-8 * (a - 0.58))) AS r FROM p)
SELECT statement_id, round(a, 6) AS anomaly_score, round(r, 6) AS risk_score, a > 0.6 AS is_fraud, {_band('r', 'inference')} AS risk_level, 'hybrid-v2' AS pipeline_version, 'small' AS model_artifact, 'small' AS scaler_artifact,
       5 AS expected_feature_count, 30 AS provided_feature_count, 'truncated' AS feature_alignment_action FROM q""",
    "retrieval_evaluation": _EVALUATED + "SELECT * FROM evaluated",
    "retrieval_summary": _EVALUATED + f"""
SELECT count(*) AS total_tests, count(*) FILTER (success) AS successful, round(count(*) FILTER (success) / count(*) + {SHIFT:.7f}, 4) AS success_rate, round(avg(mrr) + {SHIFT:.7f}, 4) AS mean_reciprocal_rank, round(avg(ndcg) + {SHIFT:.7f}, 4) AS mean_ndcg,
       round(avg(p_at_5) + {SHIFT:.7f}, 4) AS mean_precision_at_5, round(avg(latency_ms) + {SHIFT:.7f}, 4) AS mean_latency_ms FROM evaluated""",
    "index_cycle": r"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, (v[1] - v[2]) / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-10) AS m FROM e),
c AS (SELECT conv_id AS document_id, CASE WHEN conv_id % 5 = 1 THEN 'new ' ELSE '' END || coalesce(text, '') AS content, m FROM conversations LEFT JOIN u ON vec_id = (conv_id * 8 + turn) % 500)
SELECT document_id, document_id % 5 <> 2 AS exists, count(*) FILTER (document_id % 5 <> 2) AS chunks, CAST(coalesce(sum(length(content)) FILTER (document_id % 5 <> 2), 0) AS BIGINT) AS chars,
       CAST(coalesce(sum(len(regexp_extract_all(content, '\S+'))) FILTER (document_id % 5 <> 2), 0) AS BIGINT) AS words, round(coalesce(avg(length(content)) FILTER (document_id % 5 <> 2), 0), 4) AS mean_chars, CASE WHEN document_id % 5 <> 2 THEN 1.0::DOUBLE END AS norm, CASE WHEN document_id % 5 <> 2 THEN round(sum(m), 5) END AS mark FROM c GROUP BY 1""",
    "model_profile_columns": """
WITH p AS (SELECT median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.9) AS q, stddev_pop(o_totalprice) AS s FROM orders)
SELECT c_custkey, c_acctbal * 40 AS Amount, round((c_acctbal * 40 - m) / s, 5) AS pdf_amount_zscore, CAST(c_acctbal * 40 > q AS DOUBLE) AS pdf_above_pdf_p90 FROM customer, p""",
    "label_share": "SELECT count(*) AS rows, CAST(sum(quality) AS BIGINT) AS positives, round(avg(quality), 6) AS share FROM labels WHERE quality IS NOT NULL",
    "model_best": "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 1",
    "report_order": f"WITH {_REPORTS} " + " UNION ALL ".join(f"SELECT '{by}' AS sorted_by, row_number() OVER (ORDER BY {order}, id) AS place, id, name, risk_score FROM r" for by, order in (("score", "risk_score DESC"), ("name", "lower(name)"), ("date", "created_at DESC"))),
    "report_metadata": f"""
WITH d AS (SELECT 'c' || (c_custkey % 400) AS document_id, min(c_custkey) AS k, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY 1)
SELECT o_orderkey AS id, name, {_BYTES('k * 977')} AS size, coalesce(k % 3 <> 0, false) AS has_pdf, coalesce(k % 4 <> 0, false) AS has_blob FROM orders LEFT JOIN d ON document_id = 'c' || (o_orderkey % 500)""",
    "type_totals": f"WITH tx AS ({ORDERS_SQL}) SELECT statement_id, round(coalesce(sum(amount) FILTER (type = 'debit'), 0), 2) AS total_debit, count(*) FILTER (type = 'debit') AS debit_count, round(coalesce(sum(amount) FILTER (type = 'credit'), 0), 2) AS total_credit, count(*) FILTER (type = 'credit') AS credit_count FROM tx GROUP BY 1",
    "first_transactions": f"WITH tx AS ({EVENTS_SQL}) SELECT statement_id, seq, type, round(amount, 4) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY seq) AS k FROM tx) WHERE k <= 10",
    "report_accuracy": f"WITH {_REPORTS} SELECT risk_level, CAST(floor(avg(100 - risk_score) + 0.5) AS BIGINT) AS accuracy FROM r GROUP BY 1",
    "file_names": rf"""
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'risk_analysis_report' ELSE left(regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '[^a-zA-Z0-9_-]+', '_', 'g'), 80) END AS base, {_BYTES('size')} AS bytes, format('{{:,.2f}}', size / 8) AS money,
       printf('%.2f', round((p_partkey % 64) / 64 * 100, 2)) || '%' AS percent, CAST(least(500, 30 * length(CASE WHEN p_partkey % 9 = 0 THEN '' ELSE name END)) AS INT) AS preview
FROM (SELECT p_partkey, p_name || ' (v.' || p_partkey || ').final.pdf' AS name, p_partkey * p_partkey * 37 - 37 AS size FROM part)""",
    "transactions_appended": f"WITH e AS ({EVENTS_SQL}), o AS ({ORDERS_SQL}) SELECT statement_id, count(*) AS n, count(*) - 1 AS last FROM (SELECT statement_id FROM e UNION ALL SELECT statement_id FROM o) GROUP BY 1",
    "answer_prompts": _RANKED + f""",
s AS (SELECT query_id, string_agg(chr(10) || '[Section ' || rank || ']' || CASE WHEN chunk_id % 3 > 0 THEN ' Page ' || (chunk_id % 3) ELSE '' END || ' | Risk ' || source || ' (Relevance: ' || printf('%.2f', round(fs + 1e-9, 2)) || ', Confidence: ' || printf('%.2f', round(least(fs * 1.5, 1.0) + 1e-9, 2)) || ')' || chr(10) || '{"-" * 60}' || chr(10)
  || left(body, 500) || CASE WHEN length(body) > 500 THEN '... [truncated]' ELSE '' END || chr(10), '' ORDER BY rank) AS t FROM ranked WHERE rank <= 5 GROUP BY 1),
p AS (SELECT vec_id AS query_id, CASE WHEN t IS NULL THEN 'Document: doc_' || label || chr(10) || chr(10) || 'Query: risk' || chr(10) || chr(10) || 'Context: No relevant information found in the document for this query.' || chr(10) || chr(10) || 'Please respond with: "{answers.NOT_FOUND}"'
  ELSE 'Document: doc_' || label || chr(10) || chr(10) || 'Retrieved Relevant Sections:' || chr(10) || '{"=" * 60}' || chr(10) || t || chr(10) || '{"=" * 60}' || chr(10) || chr(10) || 'Query: risk' || chr(10) || chr(10) || 'Instructions:' || chr(10) || {_TEXT(answers.RULE)} END AS prompt
  FROM embeddings LEFT JOIN s ON query_id = vec_id WHERE vec_id % 50 = 0)
SELECT query_id, CAST(length(prompt) AS INT) AS n_chars, md5(prompt) AS prompt_md5 FROM p""",
    "risk_key_metrics": _features(EVENTS_SQL) + """
SELECT statement_id, CAST(total_transactions AS INT) AS total_transactions, round(total_debited, 2) AS total_debited, round(total_credited, 2) AS total_credited, CAST(high_risk_merchants AS INT) AS high_risk_merchants,
       round(max_transaction, 2) AS max_transaction_amount, CAST(unique_merchants AS INT) AS unique_merchants, CAST(greatest(txn_velocity_5min, rapid_same_merchant_transactions) AS INT) AS rapid_transactions, CAST(large_debit_transactions AS INT) AS large_debits FROM f""",
    "hybrid_verdict_grid": f"""
SELECT c_custkey, round(c, 3) AS combined_score, (a >= 0.9 OR f >= 75 OR (c >= 55 AND (a >= 0.6 OR f >= 45)) OR (flag AND (a >= 0.55 OR f >= 20))) AS is_fraud,
       CASE WHEN c >= 70 OR a >= 0.75 OR f >= 75 THEN 'high' WHEN c >= 50 OR a >= 0.5 OR f >= 50 THEN 'medium' ELSE 'low' END AS risk_level FROM ({_GRID})""",
    "band_tables": "SELECT c_custkey, " + ", ".join(f"{_band('s / 100' if k in ('detector', 'inference') else 's', k)} AS {k}" for k in scoring.BANDS) + f", {_band('CASE WHEN s <= 1 THEN s * 100 ELSE s END', 'report')} AS dashboard FROM (SELECT c_custkey, CAST(c_custkey % 101 AS DOUBLE) AS s FROM customer)",
    "calibration": "SELECT c_custkey, round(1 / (1 + exp(-8 * (x - 0.58))), 6) AS inference, round(1 / (1 + exp(-8 * (x - 0.5))), 6) AS detector FROM (SELECT c_custkey, (c_custkey % 101) / CAST(100 AS DOUBLE) AS x FROM customer)",
    "merchant_predicates": rf"""
SELECT p_partkey, regexp_matches(n, '\b({ANY(m.HIGH_RISK)})') AS high_risk, regexp_matches(n, '\b({ANY(m.SENSITIVE)})') AS sensitive, regexp_matches(n, '\b({ANY(m.LEGITIMATE)})') AS legitimate, regexp_matches(n, '{ANY(m.CASH_LIKE)}') AS cash_like
FROM (SELECT p_partkey, lower(concat_ws(' ', p_name, CASE p_partkey % 5 WHEN 0 THEN 'bar' WHEN 1 THEN 'Cryptobank' WHEN 2 THEN 'batman rental' END)) AS n FROM part)""",
    "statement_parse": """
SELECT o_orderkey AS statement_id, CAST(2 AS BIGINT) AS seq, strftime(o_orderdate, '%Y-%m-%d') AS date, round(o_totalprice, 2) AS amount, 'debit' AS type, 'Shop_' || o_custkey AS merchant FROM orders
UNION ALL SELECT o_orderkey, CAST(4 AS BIGINT), strftime(o_orderdate, '%Y-%m-%d'), round(o_totalprice, 2), 'credit', 'SALARY' FROM orders""",
    "document_signals": "SELECT doc_id, " + ", ".join(f"{_COUNT(n)} AS {n}" for n in t.PATTERNS) + " FROM documents",
    "document_statistics": r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS BIGINT) AS word_count, CAST(length(coalesce(text, '')) AS BIGINT) AS char_count,
       CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS BIGINT) AS line_count,
       round(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) / greatest(ceil(n_chars / 3000), 1), 4) AS words_per_page FROM documents""",
    "document_compliance": f"SELECT band, count(*) AS documents FROM (SELECT CASE WHEN a > 5 OR p > 3 THEN 'high' WHEN a > 0 OR p > 0 THEN 'medium' ELSE 'low' END AS band FROM (SELECT {_COUNT('account_count')} AS a, {_COUNT('pan_count')} AS p FROM documents)) GROUP BY 1",
    "document_tidy": rf"SELECT doc_id, md5(array_to_string(list_filter(list_transform({_LINES}, lambda x: trim(regexp_replace(x, '[ \t\f\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS tidy_md5 FROM documents",
    "document_masks": "SELECT c_custkey, 'PAN XXXXX' || printf('%04d', c_custkey % 10000) || 'X account ******' || right(CAST(c_custkey + 1000000000 AS VARCHAR), 4) || ' end ' || printf('%06d', c_custkey + 100000) AS masked FROM customer",
    "amount_formats": f"SELECT o_orderkey, {_MONEY('x')} AS shown FROM (SELECT o_orderkey, floor(o_totalprice / pow(10.0, o_orderkey % 5)) AS x FROM orders)",
    "page_range_join": """
WITH li AS (SELECT l_orderkey AS k, l_linenumber AS p, CAST(max(l_quantity) AS INT) AS n FROM lineitem GROUP BY 1, 2),
spans AS (SELECT k, p, coalesce(sum(n) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, n FROM li)
SELECT o_orderkey AS document_id, CAST(o_orderkey % 90 AS INT) AS position, p AS page_number FROM orders LEFT JOIN spans ON k = o_orderkey AND o_orderkey % 90 >= first AND o_orderkey % 90 < first + n""",
    "vector_search": f"WITH {_NEAR} SELECT query_id, chunk_id, round(similarity, 5) AS similarity, CAST(vector_rank AS INT) AS vector_rank FROM hits",
    "vector_threshold": f"WITH {_NEAR} SELECT query_id, chunk_id, CAST(vector_rank AS INT) AS vector_rank FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM hits) WHERE similarity >= 0.9 OR best < 0.9",
    "rerank": f"""WITH {_NEAR},
c AS (SELECT hits.*, lower(text || CASE WHEN doc_id % 3 = 0 THEN ' revenue profit index' ELSE ' Copyright footer' END) AS low, 'risk ' || source AS title FROM hits JOIN documents ON doc_id = chunk_id),
k AS (SELECT *, len(list_filter({retrieval.FINANCIAL}, lambda w: contains(low, w))) AS fin, len(list_filter({retrieval.BOILERPLATE}, lambda w: contains(low, w))) AS boiler, len(regexp_extract_all(low, '\\S+')) AS words FROM c),
s AS (SELECT *, greatest(0.0, least(1.0, (0.5 + least(fin * 0.05, 0.2) - least(boiler * 0.1, 0.3) + CASE WHEN contains(lower(title), 'risk') THEN 0.15 ELSE 0 END) * CASE WHEN words < 20 THEN 0.8 ELSE 1.0 END)) AS rr FROM k),
z AS (SELECT *, 0.7 * similarity + 0.3 * rr AS fs FROM s), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, vector_rank) AS rank FROM z)
SELECT query_id, chunk_id, round(CAST(rr AS DOUBLE), 5) AS rerank_score, round(CAST(fs AS DOUBLE), 4) AS final_score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5""",
    "ranking_metrics": f"""WITH {_NEAR}, g AS (SELECT query_id, vector_rank AS r, CASE WHEN chunk_id % 4 = 0 THEN 1.0 ELSE 0.0 END AS rel FROM hits)
SELECT query_id, round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN r END), 0), 6) AS mrr, round(sum(rel / sqrt(r)) / sum(1 / sqrt(r)), 6) AS ndcg, round(sum(rel / log2(r + 1)) / sum(1 / log2(r + 1)), 6) AS ndcg_log2, round(avg(rel), 6) AS precision FROM g GROUP BY 1""",
    "embedding_cache": r"""
WITH d AS (SELECT DISTINCT source AS document_id, md5(coalesce(text, '')) AS md5, coalesce(text, '') AS text FROM documents),
hit AS (SELECT DISTINCT source AS document_id, md5(coalesce(text, '')) AS md5 FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0),
words AS (SELECT md5, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')) AS w FROM (SELECT DISTINCT md5, text FROM d)),
hashed AS (SELECT md5, CAST('0x' || left(md5(w), 8) AS BIGINT) AS h FROM words),
sums AS (SELECT md5, h % 8 AS k, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS s FROM hashed GROUP BY 1, 2),
vectors AS (SELECT x.md5, string_agg(CAST(coalesce(s, 0) AS VARCHAR), ',' ORDER BY x.k) AS v FROM (SELECT DISTINCT md5, unnest(range(8)) AS k FROM d) x LEFT JOIN sums ON sums.md5 = x.md5 AND sums.k = x.k GROUP BY 1)
SELECT d.document_id, d.md5, hit.md5 IS NOT NULL AS cached, CASE WHEN hit.md5 IS NOT NULL THEN '0' ELSE v END AS vector FROM d LEFT JOIN hit ON hit.document_id IS NOT DISTINCT FROM d.document_id AND hit.md5 = d.md5 LEFT JOIN vectors ON vectors.md5 = d.md5""",
    "history_latest": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "history_insert": "SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'conflict' ELSE 'inserted' END AS state FROM orders",
    "history_visible": "SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS owner FROM orders WHERE o_custkey % 10 = 0 OR o_custkey = 7",
    "report_search": f"WITH {_REPORTS} SELECT id, name, risk_score FROM r WHERE risk_level = 'HIGH' AND contains(lower(name), 'statement_1')",
    "report_newest": f"WITH {_REPORTS} SELECT id, CASE WHEN length(name) > 14 THEN left(name, 14) || '...' ELSE name END AS label, risk_score FROM (SELECT * FROM r ORDER BY coalesce(updated_at, created_at) DESC, id DESC LIMIT 10)",
    "report_levels": f"WITH {_REPORTS} SELECT count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low, count(*) AS reports, CAST(floor(avg(risk_score) + 0.5) AS BIGINT) AS mean_score FROM r",
    "report_flags": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer",
    "model_metrics": """
SELECT l_returnflag, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1
FROM (SELECT l_returnflag, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn
      FROM (SELECT l_returnflag, l_quantity > 25 AS y, l_extendedprice > 50000 AS p FROM lineitem) GROUP BY 1)""",
    "model_areas": f"WITH {_STEPS} SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM cum",
    "model_curves": f"WITH {_STEPS} SELECT CAST(score AS DOUBLE) AS score, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM cum, tot",
    "model_histogram": """
WITH b AS (SELECT min(o_totalprice) AS low, (max(o_totalprice) - min(o_totalprice)) / 80 AS w, count(*) AS n FROM orders)
SELECT CAST(least(floor((o_totalprice - low) / w), 79) AS INT) AS bin, count(*) AS count, round(count(*) / (any_value(n) * any_value(w)), 10) AS density FROM orders, b GROUP BY 1""",
    "model_standardise": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 5) AS c_acctbal, CAST(0 AS DOUBLE) AS same FROM customer",
    "model_impute": "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END, (SELECT median(c_acctbal) FROM customer WHERE c_custkey % 4 <> 0)) AS c_acctbal FROM customer",
    "model_profile": "SELECT round(median(o_totalprice), 3) AS median, round(quantile_cont(o_totalprice, 0.9), 3) AS p90, round(stddev_pop(o_totalprice), 3) AS spread FROM orders",
    "model_split": """
WITH h AS (SELECT doc_id, quality, CAST('0x' || left(md5(doc_id || '-42'), 13) AS BIGINT) AS h FROM labels WHERE quality IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h) AS k, count(*) OVER (PARTITION BY quality) AS n FROM h)
SELECT doc_id, quality, k <= ceil(0.2 * n) AS is_test FROM r""",
    "model_rank": "SELECT p_brand, n, CAST(row_number() OVER (ORDER BY n DESC, auc DESC, p_brand DESC) AS INT) AS rank FROM (SELECT p_brand, avg(p_retailprice) AS auc, count(*) AS n FROM part GROUP BY 1)",
    "event_velocity": "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 4) AS amount FROM events GROUP BY 1, 2",
    "answer_parse": f"""
WITH a AS (
  SELECT conv_id, turn, CASE turn % 5
    WHEN 0 THEN 'Well.' || chr(10) || '- **Answer:** ' || b || chr(13) || chr(10) || chr(10) || chr(9) || ' more ' || chr(160) || chr(10) || '- **Confidence:** HIGH' || chr(10) || '- **Source:** Section 1' || chr(10)
    WHEN 1 THEN '**Source:** lost' || chr(10) || '**Answer:** old' || chr(10) || b || chr(10) || '**Source:** a **Answer:** ' || b || chr(10) || '**Context:**' || chr(10) || b
    WHEN 2 THEN {_TEXT(answers.MOCK_ANSWER)} || chr(10) || b
    WHEN 3 THEN b || chr(10) || '* **Context:** one' || chr(10) || '**Context:** two **Confidence:** LOW' || chr(10) || 'last **Confidence:**'
    ELSE b END AS t FROM (SELECT conv_id, turn, coalesce(text, '') AS b FROM conversations)),
l AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM a),
m AS (SELECT *, CASE WHEN contains(x, '**Answer:**') THEN 'Answer' WHEN contains(x, '**Source:**') THEN 'Source' WHEN contains(x, '**Confidence:**') THEN 'Confidence' WHEN contains(x, '**Context:**') THEN 'Context' END AS f FROM l),
k AS (SELECT *, count(f) OVER (PARTITION BY conv_id, turn ORDER BY i) AS k, trim(CASE WHEN f IS NULL THEN x ELSE substr(x, instr(x, '**' || f || ':**') + length(f) + 5) END, {_WHITE}) AS piece FROM m),
v AS (SELECT conv_id, turn, k, max(f) AS f, coalesce(string_agg(piece, chr(10) ORDER BY i) FILTER (piece <> ''), '') AS v FROM k WHERE k > 0 GROUP BY 1, 2, 3),
s AS (SELECT conv_id, turn, k, f, v FROM (SELECT *, lead(f) OVER (PARTITION BY conv_id, turn ORDER BY k) AS after FROM v) WHERE after IS DISTINCT FROM 'Answer')
SELECT a.conv_id, a.turn, coalesce(arg_max(v, k) FILTER (f = 'Answer'), '') AS answer, coalesce(arg_max(v, k) FILTER (f = 'Source'), '') AS source, coalesce(arg_max(v, k) FILTER (f = 'Confidence'), 'UNKNOWN') AS confidence,
       coalesce(arg_max(v, k) FILTER (f = 'Context'), '') AS context FROM a LEFT JOIN s ON s.conv_id = a.conv_id AND s.turn = a.turn GROUP BY 1, 2""",
    "section_titles": rf"""
WITH l AS (
  SELECT conv_id, turn, list_transform(string_split(CASE WHEN turn % 2 = 0 THEN 'intro' || chr(10) ELSE '' END
    || CASE turn % 5 WHEN 0 THEN chr(9) || '# ' WHEN 1 THEN chr(160) || chr(8201) || '12. ' WHEN 2 THEN 'TOTAL SUMS:' || chr(13) || chr(10) ELSE '' END || text || chr(13), chr(10))[1:3], lambda x: trim(x, {_WHITE})) AS lines FROM conversations)
SELECT conv_id, turn, list_filter(lines, lambda x: regexp_matches(x, '^(#{{1,3}}|[A-Z][A-Z\s]+:|\d+\.)'))[1] AS title FROM l""",
}
