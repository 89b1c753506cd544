"""Prompts, parsed answers and response envelopes for many queries, and reports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import format_money, preview, rounded, stripped

from .scoring import band, clamp

# What readers of prompts, answers and reports rely on.
SHOWN_CHARS = 500
NOT_FOUND = "Information not found in document."
FIELDS = ["answer", "source", "confidence", "context"]
METRICS = [
    ("Total Transactions", "total_transactions", False), ("Total Debited", "total_debited", True), ("Total Credited", "total_credited", True), ("High-Risk Merchants", "high_risk_merchants", False),
    ("Max Transaction", "max_transaction_amount", True), ("Unique Merchants", "unique_merchants", False), ("Rapid Transactions (5min)", "rapid_transactions", False), ("Large Debits", "large_debits", False),
]
ACTIONS = [("URGENT", "Immediate manual review required"), ("Manual compliance review", "Manual compliance review required"), ("Enhanced monitoring", "Enhanced monitoring recommended"), ("Continue standard monitoring", "Continue monitoring")]
MARKS = {"HIGH": "🔴", "MEDIUM": "🟡", "LOW": "🟢"}
#: What scores may be below the decimals that their weights make: 0.895 is a tie, though the double is a little less.
NUDGE = 1e-9
RULE = "1. Use ONLY the retrieved sections above to answer.\n2. If the answer cannot be found in the retrieved sections, respond with \"Information not found in document.\"\n3. Always cite which section (by number above) your answer comes from.\n4. Provide confidence level (HIGH/MEDIUM/LOW) for your answer.\n5. Use the response template: Answer | Source | Confidence | Context"


def section(rank: Column, page: Column, title: Column, score: Column, confidence: Column, content: Column) -> Column:
    """One retrieved chunk as the prompt shows it."""
    shown = lambda x: F.format_string("%.2f", rounded(x + NUDGE, 2))
    head = F.concat(
        F.lit("[Section "), rank.cast("string"), F.lit("]"), F.when(page > 0, F.concat(F.lit(" Page "), page.cast("string"))).otherwise(""), F.when(title != "", F.concat(F.lit(" | "), title)).otherwise(""),
        F.lit(" (Relevance: "), shown(score), F.lit(", Confidence: "), shown(confidence), F.lit(")"),
    )
    return F.concat(F.lit("\n"), head, F.lit("\n" + "-" * 60 + "\n"), preview(content, SHOWN_CHARS), F.when(F.length(content) > SHOWN_CHARS, "... [truncated]").otherwise(""), F.lit("\n"))


def prompts(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, prompt): the user message of each query (query_id, query, document_name) with its ranked chunks; at most k chunks each."""
    text = section(F.col("rank"), F.col("page_number"), F.coalesce("section_title", F.lit("")), F.col("final_score"), F.col("confidence"), F.col("content"))
    found = ranked.select("query_id", "rank", text.alias("_s")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "_s"))).alias("_all"))
    line = "=" * 60 + "\n"
    name = F.concat(F.lit("Document: "), F.col("document_name"), F.lit("\n"))
    full = F.concat(name, F.lit(f"\nRetrieved Relevant Sections:\n{line}"), F.array_join(F.transform("_all", lambda s: s["_s"]), ""), F.lit(f"\n{line}\nQuery: "), F.col("query"), F.lit(f"\n\nInstructions:\n{RULE}"))
    empty = F.concat(name, F.lit("\nQuery: "), F.col("query"), F.lit(f"\n\nContext: No relevant information found in the document for this query.\n\nPlease respond with: \"{NOT_FOUND}\""))
    return queries.join(found, "query_id", "left").select("query_id", F.when(F.col("_all").isNull(), empty).otherwise(full).alias("prompt"))


def parsed(answer: Column) -> Column:
    """Struct of answer, source, confidence and context from a marked answer, as prompts ask for it (bullets or other text may stand before a mark).

    A line belongs to the first of the four marks, in this order, that it holds; what follows the mark, and the lines up to the next marked
    one, are the field's, without white space around, empty ones dropped. The last of several fields of a name counts. A field
    that an answer's mark follows is given up: an answer begins anew. Lines before all marks belong to none.
    """
    lines = F.split(answer, "\n")
    marks = [F.lit(f"**{name.capitalize()}:**") for name in FIELDS]
    size = [len(f"**{name.capitalize()}:**") for name in FIELDS]

    def head(line: Column, at: Column) -> Column:
        kind, rest = F.lit(None).cast("int"), F.lit(None).cast("string")
        for i in reversed(range(len(FIELDS))):
            holds = F.contains(line, marks[i])
            kind = F.when(holds, i).otherwise(kind)
            rest = F.when(holds, F.substring(line, F.instr(line, marks[i]) + size[i], F.length(line))).otherwise(rest)
        return F.struct(at.alias("at"), kind.alias("kind"), rest.alias("rest"))

    heads = F.filter(F.transform(lines, head), lambda h: h["kind"].isNotNull())

    def block(h: Column, i: Column) -> Column:
        after = F.get(heads, i + 1)
        body = F.concat(F.array(h["rest"]), F.slice(lines, h["at"] + 2, F.coalesce(after["at"], F.size(lines)) - h["at"] - 1))
        kept = F.filter(F.transform(body, stripped), lambda x: x != "")
        return F.struct(F.when(after["kind"].isNull() | (after["kind"] != 0), h["kind"]).alias("kind"), F.array_join(kept, "\n").alias("value"))

    blocks = F.transform(heads, block)

    def field(i: int, name: str) -> Column:
        own = F.filter(blocks, lambda b: b["kind"] == i)
        return F.coalesce(F.get(own, F.size(own) - 1)["value"], F.when(answer.isNotNull(), "UNKNOWN" if name == "confidence" else "")).alias(name)

    return F.struct(*[field(i, name) for i, name in enumerate(FIELDS)])


def responses(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, query, answer, source, confidence, context, citations, chunks_retrieved) from (query_id, query, answer_text); a null text is an error."""
    cite = F.struct("rank", "chunk_id", F.col("page_number").alias("page"), F.col("section_title").alias("section"), F.format_string("%.3f", "final_score").alias("relevance_score"))
    cited = ranked.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(cite)), lambda c: c.dropFields("rank")).alias("_cited"))
    rows = answers.join(cited, "query_id", "left").withColumn("_p", parsed(F.coalesce("answer_text", F.lit(""))))
    lost = F.col("answer_text").isNull()
    none = F.array().cast(cited.schema["_cited"].dataType)
    return rows.select(
        "query_id", "query", F.when(lost, NOT_FOUND).otherwise(F.col("_p.answer")).alias("answer"), F.when(lost, "N/A").otherwise(F.col("_p.source")).alias("source"), F.when(lost, "LOW").otherwise(F.col("_p.confidence")).alias("confidence"),
        F.when(lost, "Error: no answer").otherwise(F.col("_p.context")).alias("context"), F.when(lost, none).otherwise(F.coalesce("_cited", none)).alias("citations"), F.when(lost, 0).otherwise(F.size(F.coalesce("_cited", none))).alias("chunks_retrieved"),
    )


def text_report(insights: Column | None = None) -> Column:
    """The report of a row with report_id, generated, document_name, risk_level, risk_score, model_risk, is_fraud, reasons, key_metrics, recommendation."""
    thick, thin = "=" * 70, "-" * 70
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    shown = lambda c, is_money: money(c) if is_money else c.cast("string")
    title = lambda name: F.lit(f"{thin}\n{name}\n{thin}")
    issues = F.array_join(F.transform("reasons", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")
    parts = [
        F.lit(f"{thick}\nFINANCIAL RISK COMPLIANCE REPORT\n{thick}\n"), F.concat(F.lit("Report ID: "), F.col("report_id")), F.concat(F.lit("Generated: "), F.col("generated")), F.concat(F.lit("Document: "), F.col("document_name"), F.lit("\n")),
        title("RISK ASSESSMENT"), F.concat(F.lit("Risk Level: "), F.col("risk_level"), F.lit(" ("), rounded(F.col("risk_score"), 2).cast("string"), F.lit("/100)")), F.concat(F.lit("ML Anomaly Score: "), rounded(F.col("model_risk"), 4).cast("string")),
        F.concat(F.lit("Fraud Verdict: "), F.when(F.col("is_fraud"), "YES - Fraudulent activity detected").otherwise("NO - Activity within normal range"), F.lit("\n")),
        title("DETECTED ISSUES"), F.concat(F.when(F.size("reasons") > 0, issues).otherwise("No significant issues detected."), F.lit("\n")),
        title("KEY TRANSACTION METRICS"), *[F.concat(F.lit(f"{label}: "), shown(F.col(f"key_metrics.{c}"), is_money), F.lit("\n" if label == "Large Debits" else "")) for label, c, is_money in METRICS],
        title("RECOMMENDATION"), F.concat(F.col("recommendation"), F.lit("\n")),
    ]
    if insights is not None:
        told = F.array_join(F.transform(F.map_entries(insights), lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"])), "\n")
        parts.append(F.when(insights.isNotNull(), F.concat(F.lit(f"{thin}\nDOCUMENT INSIGHTS\n{thin}\n"), told, F.lit("\n"))))
    return F.concat_ws("\n", *parts, F.lit(f"{thick}\nEND OF REPORT\n{thick}"))


def summary_report() -> Column:
    """One line of mark, level and score, document, the first three issues and the action."""
    mark = F.coalesce(*[F.when(F.col("risk_level") == k, v) for k, v in MARKS.items()], F.lit("⚪"))
    more = F.when(F.size("reasons") > 3, F.concat(F.lit(" (+"), (F.size("reasons") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    issues = F.when(F.size("reasons") > 0, F.concat(F.lit("Issues: "), F.array_join(F.slice("reasons", 1, 3), ", "), more))
    action = F.coalesce(*[F.when(F.contains("recommendation", F.lit(k)), v) for k, v in ACTIONS], F.lit("No immediate action required"))
    return F.concat_ws(" | ", F.concat(mark, F.lit(" "), F.col("risk_level"), F.lit(" Risk Score: "), rounded(F.col("risk_score"), 2).cast("string"), F.lit("/100")), F.concat(F.lit("Document: "), F.col("document_name")), issues, F.concat(F.lit("Action: "), action))


def offline_summary(score: Column, fraud: Column, issues: Column) -> Column:
    """What stands for a language model's summary where there is none."""
    return F.concat(
        F.lit("This analysis identified a risk score of "), score.cast("string"), F.lit("/100 with "), F.when(fraud, "fraudulent activity detected").otherwise("no fraud detected"), F.lit(". "), F.size(issues).cast("string"),
        F.lit(" suspicious patterns were flagged. "), F.when(fraud, "Immediate manual review is recommended.").otherwise("Standard monitoring procedures apply."),
    )


#: Fixed value: the answer of a pipeline without a model.
MOCK_ANSWER = (
    "- **Answer:** Based on the retrieved document sections, the information appears to indicate [specific data from context].\n"
    "- **Source:** Financial Summary section, page 2-3\n"
    "- **Confidence:** MEDIUM\n"
    "- **Context:** This information is extracted from multiple document sections and synthesized based on the most relevant retrieved segments."
)
# What the prompts for reports ask for.
SUMMARY_TASK = "Generate a professional 3-paragraph summary:\n1. Overall risk assessment\n2. Key red flags and patterns\n3. Recommended action\n\nKeep it factual, concise, and actionable for compliance review."
ADVICE_TASK = (
    "Generate a specific, actionable recommendation for compliance officers.\nInclude:\n1. Action urgency based on risk band\n2. Specific next steps (verification, investigation, monitoring)\n3. Timeline for action\n\n"
    "Severity policy (must follow):\n- HIGH: may use urgent language and immediate manual review.\n- MEDIUM: do NOT use urgent/immediate language; recommend enhanced monitoring and targeted review.\n- LOW: no immediate action required.\n\nKeep it under 100 words."
)


def summary_prompt(score: Column) -> Column:
    """The prompt for a summary of a row with document_name, is_fraud, key_metrics and reasons, of which the first ten are numbered."""
    count = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(f"key_metrics.{c}").cast("string"))
    money = lambda label, c: F.concat(F.lit(f"- {label}: $"), format_money(F.col(f"key_metrics.{c}")))
    issues = F.transform(F.slice("reasons", 1, 10), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    return F.concat_ws(
        "\n", F.lit("Analyze this financial document fraud assessment:\n"), F.concat(F.lit("**Document:** "), F.col("document_name")), F.concat(F.lit("**Risk Score:** "), score.cast("string"), F.lit("/100")),
        F.concat(F.lit("**Fraud Verdict:** "), F.when(F.col("is_fraud"), "FRAUDULENT ACTIVITY DETECTED").otherwise("No fraud detected"), F.lit("\n")), F.lit("**Transaction Metrics:**"),
        count("Total Transactions", "total_transactions"), money("Total Debited", "total_debited"), money("Total Credited", "total_credited"), count("High-Risk Merchants", "high_risk_merchants"),
        money("Max Transaction", "max_transaction_amount"), F.concat(count("Rapid Transactions", "rapid_transactions"), F.lit("\n")), F.lit("**Detected Issues:**"), F.concat(F.array_join(issues, "\n"), F.lit("\n")), F.lit(SUMMARY_TASK),
    )


def advice_prompt(score: Column) -> Column:
    """The prompt for a recommendation: score, its band, and the first five reasons of a row with is_fraud and reasons."""
    issues = F.transform(F.slice("reasons", 1, 5), lambda r: F.concat(F.lit("- "), r))
    return F.concat_ws(
        "\n", F.lit("Based on this fraud analysis:\n"), F.concat(F.lit("- Risk Score: "), score.cast("string"), F.lit("/100")), F.concat(F.lit("- Risk Band: "), band(clamp(score, 0.0, 100.0), "prompt")),
        F.concat(F.lit("- Fraud Detected: "), F.when(F.col("is_fraud"), "YES").otherwise("NO")), F.concat(F.lit("- Flagged Issues: "), F.size("reasons").cast("string"), F.lit("\n")), F.lit("Issues:"), F.concat(F.array_join(issues, "\n"), F.lit("\n")), F.lit(ADVICE_TASK),
    )
