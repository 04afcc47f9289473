"""One question at a time: retrieve, refuse or answer. The form that a command line and a service use."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answer, search
from .stages import NAMESPACE, Embedder, hashed_words


class Asker:
    """Vectors, prices and a generator that stay the same from question to question."""

    def __init__(self, spark: SparkSession, vectors: DataFrame, prices: answer.Prices = (), embed: Embedder = hashed_words, generator=answer.quoting_generator, name: str = NAMESPACE):
        self.spark, self.vectors, self.embed, self.generator, self.name = spark, vectors, embed, generator, name
        self.prices = spark.createDataFrame(list(prices), "model string, input_price double, output_price double")

    def ask(self, question: str, top_k: int = search.TOP_K, threshold: float = search.REFUSAL, model: str = "offline", doc_kind: str | None = None) -> dict[str, Any]:
        """question, answer, refused, model, hits (without texts) and usage with estimated_cost_usd."""
        answer.validate_request(question, top_k, threshold, doc_kind)
        q = [float(x) for x in self.embed([question])[0]]
        asked = self.spark.createDataFrame([(0, question, q)], "query_id int, question string, q array<double>")
        out = answer.answer_questions(asked, self.vectors, self.prices, model, top_k, threshold, search.build_filter(doc_kind), self.generator)
        r = out.first()
        hits = [{k: h[k] for k in ("rank", "chunk_id", "doc_id", "doc_kind", "page_nos", "case_nums", "score")} for h in r["hits"] or []]
        return {"question": question, "answer": r["answer"], "refused": r["refused"], "model": model, "hits": hits, "usage": {**r["usage"].asDict(), "estimated_cost_usd": round(r["cost_usd"], 6)}}


def vectors_of(records: DataFrame) -> DataFrame:
    """Stored records as the rows that a search reads."""
    return search.to_hits(records).select(F.col("_id").alias("chunk_id"), "embedding", "doc_id", "doc_kind", "page_nos", "case_nums", "text")
