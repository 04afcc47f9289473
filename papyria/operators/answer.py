"""Answers: refusal text, prompt assembly, a pluggable generator, costs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .search import REFUSAL, refusals, search_many

#: Dollars for a million tokens in and out, by model; a bounded list, broadcast in joins.
Prices = list[tuple[str, float, float]]
USAGE = "struct<input_tokens:int,output_tokens:int>"


def excerpt_label(rank: Column) -> Column:
    """One line that names the document, pages, kind, case numbers and score of an excerpt, then its text."""
    pages = F.array_join(F.col("page_nos").cast("array<string>"), ", ")
    cases = F.when(F.size("case_nums") > 0, F.array_join("case_nums", ", ")).otherwise("—")
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.col("doc_id"), F.lit(" | pages "), pages, F.lit(" | kind="), F.col("doc_kind"), F.lit(" | case#="), cases, F.lit(" | retrieval_score="), F.format_string("%.3f", "score"))
    return F.concat(head, F.lit("\n"), F.col("text"))


REMINDER = "Use nothing but these excerpts. After each claim give its source as [doc-id, p.N]. Say so if they hold no answer."


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, prompt: excerpts by rank first, the question last. hits hold at most k rows for each question."""
    ex = hits.withColumn("__x", F.struct("rank", excerpt_label(F.col("rank")).alias("x")))
    ex = ex.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("__x")), lambda e: e["x"]), "\n\n").alias("excerpts"))
    q = questions.select("query_id", "question").join(ex, "query_id", "left")
    return q.select("query_id", F.concat(F.lit("DOCUMENT EXCERPTS:\n\n"), F.coalesce("excerpts", F.lit("")), F.lit("\n\n---\n\nQUESTION: "), "question", F.lit(f"\n\n{REMINDER}")).alias("prompt"))


def refusal_text(threshold: Column | float = REFUSAL) -> Column:
    """Of question, top_score, top_doc and top_pages: two forms, with the threshold that was applied."""
    th = threshold if isinstance(threshold, Column) else F.lit(threshold)
    none = F.concat(F.lit("No document matches this question:\n  "), "question", F.lit("\n"))
    weak = F.concat(F.lit("The documents hold no confident answer to this question:\n  "), "question", F.lit("\n\nThe closest match (score="), F.format_string("%.3f", "top_score"), F.lit(", threshold="), th.cast("string"), F.lit(") is "), "top_doc", F.lit(" on page(s) "), F.array_join(F.col("top_pages").cast("array<string>"), ", "), F.lit("."))
    return F.when(F.col("top_score").isNull(), none).otherwise(weak)


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens) plus cost_usd; an unknown model costs 0."""
    p = F.broadcast(prices.select(F.col("model").alias("__m"), "input_price", "output_price"))
    j = usage.join(p, F.col("model") == F.col("__m"), "left")
    return j.withColumn("cost_usd", F.coalesce(t.money_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_price"), F.col("output_price")), F.lit(0.0))).drop("__m", "input_price", "output_price")


def quoting_generator(prompt: str) -> tuple[str, int, int]:
    """Offline stand-in: quotes the first excerpt and cites it."""
    head, _, rest = prompt.partition("\n[" if "\n[" in prompt else "\n\n")[2].partition("\n")
    doc = head.split("] ", 1)[-1].split(" | ", 1)[0]
    page = head.split("pages ", 1)[-1].split(" ", 1)[0].rstrip(",")
    text = f"{rest.split('. ')[0].strip()[:200]} [{doc}, p.{page}]"
    return text, len(prompt.split()), len(text.split())


def generate(prompts: DataFrame, generator: Callable[[str], tuple[str, int, int]] = quoting_generator) -> DataFrame:
    """query_id, answer, usage. The generator is called once for each row, in batches of a task."""

    def run(frames):
        for f in frames:
            rows = [generator(p) for p in f["prompt"]]
            yield pd.DataFrame({"query_id": f["query_id"], "answer": [r[0] for r in rows], "input_tokens": [r[1] for r in rows], "output_tokens": [r[2] for r in rows]})

    kind = prompts.schema["query_id"].dataType.simpleString()
    out = prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string, input_tokens int, output_tokens int")
    return out.select("query_id", "answer", F.struct("input_tokens", "output_tokens").alias("usage"))


def answer_questions(questions: DataFrame, vectors: DataFrame, prices: DataFrame, model: str = "offline", k: int = 5, threshold: float = REFUSAL, spec: dict | None = None, generator=quoting_generator) -> DataFrame:
    """question, answer, refused, model, hits, usage, cost_usd. Refused questions never reach the generator.

    questions: query_id, question, q (vector); vectors: chunk_id, embedding and the fields of a hit."""
    found = search_many(vectors, questions.select("query_id", "q"), k, spec).join(vectors.drop("embedding"), "chunk_id")
    gate = refusals(questions, found, threshold)
    hit = F.struct("rank", "score", "chunk_id", "doc_id", "doc_kind", "page_nos", "case_nums", "text")
    hits = found.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    answered = generate(prompts(questions.join(gate.where(~F.col("refused")), "query_id", "left_semi"), found), generator)
    q = questions.select("query_id", "question").join(gate, "query_id").join(hits, "query_id", "left").join(answered, "query_id", "left")
    q = q.withColumns({"top_doc": F.get("hits", F.lit(0))["doc_id"], "top_pages": F.get("hits", F.lit(0))["page_nos"], "model": F.lit(model), "input_tokens": F.coalesce("usage.input_tokens", F.lit(0)), "output_tokens": F.coalesce("usage.output_tokens", F.lit(0))})
    q = costs(q, prices)
    return q.select("query_id", "question", F.when(F.col("refused"), refusal_text(threshold)).otherwise(F.col("answer")).alias("answer"), "refused", "model", "hits", F.struct("input_tokens", "output_tokens").alias("usage"), "cost_usd")


def validate_request(question: str, top_k: int = 5, threshold: float = REFUSAL, doc_kind: str | None = None, kinds: tuple[str, ...] = ("teletype", "newspaper", "form", "loose", "cover", "deletion-sheet", "legal", "memo", "court-opinion")) -> None:
    """Refuse a bad request before any plan is built."""
    if not 1 <= len(question) <= 1000:
        raise ValueError("a question has 1 to 1000 characters")
    if not 1 <= top_k <= 20:
        raise ValueError("top_k is 1 to 20")
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is 0 to 1")
    if doc_kind is not None and doc_kind not in kinds:
        raise ValueError(f"doc_kind is one of {', '.join(kinds)}")
