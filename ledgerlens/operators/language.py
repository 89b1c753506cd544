"""A pluggable language model over rows: prompts in lots to any client, and the offline texts where there is none or it fails.

A client is a function (prompts, system message) -> texts, one for each prompt, that can be pickled and makes its own connections. It is
called with lots of ``LOT`` prompts within a task. If a lot fails, or gives another number of texts, each of its prompts is tried alone;
one that still fails after ``ATTEMPTS`` has no text but an error, and the row's offline text counts. Blank texts are failures
too. Null prompts aren't sent. A task that is run again asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers, explain

LOT, ATTEMPTS = 16, 2
Client = Callable[[list[str], str], list[str]]
# What the model is told to be.
SUMMARISER = "You are a financial compliance expert analyzing bank statements for fraud. Generate concise, professional summaries highlighting risk factors and recommendations. Use clear, actionable language suitable for compliance officers."
ADVISER = "You are a senior compliance officer providing actionable fraud prevention recommendations."


def asked(client: Client, prompts: list[str], system: str, attempts: int) -> list[tuple[str | None, str | None]]:
    """(text, error) of each prompt."""

    def tried(part: list[str]) -> list[tuple[str | None, str | None]]:
        texts = list(client(part, system))
        if len(texts) != len(part):
            raise ValueError(f"{len(texts)} texts for {len(part)} prompts")
        return [(t.strip(), None) if isinstance(t, str) and t.strip() else (None, "an empty text") for t in texts]

    try:
        found = tried(prompts)
    except Exception as e:  # a client may fail in any way
        found = [(None, f"{type(e).__name__}: {e}")] * len(prompts)
    out = []
    for prompt, (text, error) in zip(prompts, found, strict=True):
        for _ in range(attempts if error else 0):
            try:
                [(text, error)] = tried([prompt])
            except Exception as e:
                text, error = None, f"{type(e).__name__}: {e}"
            if not error:
                break
        out.append((text, error))
    return out


def completed(prompt: Column, client: Client | None, system: str, lot: int = LOT, attempts: int = ATTEMPTS) -> Column:
    """Struct of text and error of the model's answer to each prompt; asked once a row, whatever is made of it."""
    if client is None:
        return F.struct(F.lit(None).cast("string").alias("text"), F.lit("no client").alias("error"))

    @F.pandas_udf("text string, error string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[str | None, str | None]] = [(None, None)] * len(batch)
            given = [i for i, p in enumerate(batch) if p is not None]
            for a in range(0, len(given), lot):
                part = given[a : a + lot]
                for i, told in zip(part, asked(client, [batch.iloc[i] for i in part], system, attempts), strict=True):
                    out[i] = told
            yield pd.DataFrame(out, columns=["text", "error"])

    return answer.asNondeterministic()(prompt)


def report_texts(rows: DataFrame, client: Client | None, score: Column) -> DataFrame:
    """``rows`` of ``plans.risk.analyse`` (with document_name) and llm_summary, llm_recommendation, and summary_by and recommendation_by: model or offline.

    A recommendation that is more urgent than ``score`` allows is replaced by the offline one.
    """
    told = rows.withColumn("_score", score).withColumn("_s", completed(answers.summary_prompt(F.col("_score")), client, SUMMARISER)).withColumn("_r", completed(answers.advice_prompt(F.col("_score")), client, ADVISER))
    s, fraud = F.col("_score"), F.col("is_fraud")
    safe = explain.normalised_recommendation(F.col("_r.text"), s, fraud)
    by = lambda c, own: F.when(F.col(f"{c}.text").isNotNull() & own, "model").otherwise("offline")
    return told.withColumns({
        "llm_summary": F.coalesce("_s.text", answers.offline_summary(s, fraud, F.col("reasons"))), "summary_by": by("_s", F.lit(True)),
        "llm_recommendation": safe, "recommendation_by": by("_r", safe == F.col("_r.text")), "llm_errors": F.filter(F.array("_s.error", "_r.error"), lambda e: e.isNotNull()),
    }).drop("_score", "_s", "_r")


def answered(prompts: DataFrame, client: Client | None, system: str) -> DataFrame:
    """``prompts`` (query_id, prompt) with answer_text, null where the model gave none, as ``answers.responses`` takes it."""
    return prompts.withColumn("_a", completed(F.col("prompt"), client, system)).withColumn("answer_text", F.col("_a.text")).drop("_a")
