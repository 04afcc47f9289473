"""From raw documents to packed training sequences: five stages over the operators of papyria.llm.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyria.llm import classifier, decontam, linedup, minhash, packing
from papyria.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. It learns from the labelled rows of documents."""
    model = classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that ten documents or more share stays in the one of the smallest id; no document goes."""
    return linedup.deduped(docs, min_docs=10, min_chars=1, keep_first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 0.8 or more similarity of five-word shingles stays: that of the smallest id."""
    return minhash.near_dedup(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of eight words or more of a benchmark item go."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"), window=8, min_run=8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, capacity=1024, end_id=0)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pack", pack)]

#: A compression classifier and a tokenizer have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
