"""The queries opN_<name>: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontam, html, licenses, linedup, minhash, packing, rules, substring, tokens
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=8, min_items=2)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"), window=20)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"), end_id=2)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.classify(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the repository, and the id gives directories of a thousand and a hundred files,
    the first three of each hundred being licence files by name."""
    n = F.coalesce("doc_id", F.lit(0))
    step = lambda k: F.floor(n / k).cast("string")
    name = F.when(F.pmod(n, F.lit(100)) < 3, F.concat(F.lit("LICENSE-"), n.cast("string"))).otherwise(F.concat(F.lit("file-"), n.cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), F.concat_ws("/", F.concat(F.lit("t"), step(1000)), F.concat(F.lit("h"), step(100)), name).alias("path"), "text")
    return licenses.scan_licenses(files)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_packing, op3_decontamination, op4_substring_dedup, op5_minhash_dedup, op6_token_files, op7_line_dedup, op8_quality_rules, op9_quality_classifier, op10_license_scan)
}
