"""Table functions, called from SQL, against the column expressions on hostile lines made from documents."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import tables
from ledgerlens.operators import retrieval
from ledgerlens.operators.transactions import parse

DATES = ["05 Jan 2025", "5/1/2025", "05-01-25", "2025/1/5", "2025-01-05", "Jan 5, 2025", "January 05 2025", "31/02/2025", "5 Sept 2025", "5 Mayor 2025", "5/1/68", "5/1/70", "99/99/9999", "1/2/345", "5 Jan\t2025", "05 JAN 25", "Jan 5,2025", "2025-1-5", "٠٥/٠١/٢٠٢٥", "12 jun 0001", "29 Feb 2024", "29/2/23", "5 Dec 20256"]
AMOUNTS = ["₹45,000", "Rs. 12.5", "rs 7", "INR1200", "$3.456", "45000 DR", "45000Cr", "1,2,3.45", "919919523", "1200.00", "12345678", "123456789", "123456789.10", "0", ",5", "5,", "1.2.3", "٣٤٥", "99 cr", "10 Dr", "7CRORE", "000", "1,,2", "5.", "9999999999999999999999.5"]
WORDS = ["UPI", "pos", "debit", "credit", "to", "by", "ACME_PAYROLL", "Shop-7", "a/b", "&", "|", "::", "balance", "Opening Balance", "refund", "Salary", "charges", "é", "-", ".", "ref", "12", "İ", "x y", "Zoë Café", "fee.", "😀", "𝟗𝟗"]
BREAKS = ["\n", "\n", "\n", "\r\n", "\r", " ", "\x0b", "\x1c", "\x85", "\n\n"]
BLANKS = [" ", " ", " ", "  ", "\t", " ", "\x1f", "　", ""]


def hostile(seed, words):
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randrange(1, 30)):
        parts = [rng.choice(rng.choice([DATES, AMOUNTS, AMOUNTS, WORDS, words])) for _ in range(rng.randrange(0, 9))]
        if rng.random() < 0.7:
            parts.insert(rng.randrange(0, 2), rng.choice(DATES))
        out.append("".join(p + rng.choice(BLANKS) for p in parts) + rng.choice(BREAKS))
    return "".join(out)


@pytest.fixture(scope="module")
def texts(spark, sf):
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    words = [w for x in docs for w in (x or "").split()][:4000] or ["x"]
    rows = [(str(i), hostile(i, words)) for i in range(700)] + [("null", None), ("empty", ""), ("one", "05 Jan 2025 POS Debit ₹45000 CasinoXYZ")]
    return spark.createDataFrame(rows, "statement_id string, text string").cache()


def test_parse_statement(spark, texts):
    tables.register(spark)
    texts.createOrReplaceTempView("statements")
    told = {(r["statement_id"], r["seq"]): (r["date"], r["amount"], r["type"], r["merchant"]) for r in spark.sql("SELECT s.statement_id, p.* FROM statements s, LATERAL parse_statement(s.text) p").collect()}
    found = {(r["statement_id"], r["seq"]): (r["date"], r["amount"], r["type"], r["merchant"]) for r in parse(texts).collect()}
    lines = {r["statement_id"]: (r["text"] or "").splitlines() for r in texts.collect()}
    assert len(told) > 1000
    wrong = [(lines[k[0]][k[1]], told.get(k), found.get(k)) for k in sorted({*told, *found}) if told.get(k) != found.get(k)]
    assert not wrong, (len(wrong), wrong[:5])


def test_chunk_document(spark, sf):
    tables.register(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("d"), "text")
    docs.createOrReplaceTempView("docs")
    told = sorted(map(str, map(tuple, spark.sql("SELECT c.* FROM docs d, LATERAL chunk_document(d.d, d.text, 100, 20) c").collect())))
    found = retrieval.chunk_documents(docs, 100, 20, key="d").select("chunk_id", "position", "page_number", "page_by_offset", "section_title", "content", "word_count", "char_count")
    assert told == sorted(map(str, map(tuple, found.collect()))) and len(told) > 200
