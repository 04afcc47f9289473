"""Derived inputs for the registered queries, as SQL that Spark and DuckDB both run.

The driver tables hold no forms, dates or dollar amounts; pages with such lines are projected from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        read(spark, sf_dir, n).createOrReplaceTempView(n)


#: Pages of a source, numbered by document. Ratios are compared as integers: letters * 100 >= 55 * chars.
PAGES = """
SELECT source AS source_stem, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_no, doc_id AS doc_no,
  CAST(length(text) AS INT) AS char_count, CAST(doc_id * 37 % 1000 AS INT) AS conf_tenths, text AS raw_text, lang
FROM documents"""

_BEFORE = {
    0: "FD-36 (Rev. 7-27-76)\nFM SALT LAKE CITY 88-6895 TO DENVER ROUTINE\nBT\n",
    1: "FD-36 (Rev. 7-27-76)\nTRANSMIT VIA Teletype\nFM SEATTLE\nBT\n",
    2: "PAGE TWO DN 88-6895 CLEAR\n",
    3: "PAGE THREE DN 88-10975 CLEAR\n",
    4: "FD-350 (Rev. 7-16-63)\n(Mount Clipping in Space Below)\n",
    5: "continued from A-1\n",
    6: "4-750 (Rev. 12-14-88)\n(b)(7)(C) b7D b3\nSU 88-6895-7 p.1\n",
    7: "FD-302 (Rev. 1-1-75)\n",
    8: "JUNE 9, 1977\nreward of $ 1,500.00 offered\nfile 88-6895-12\n",
    9: "SEARCHED ____ INDEXED ____\nSERIALIZED ___ by hand\n. FILED ;\nComplaint filed before noon\nRR SU AT NK NY PH SF\nae meme ieee ree eee eee ee\n~~ 12 %% ** (( )) __ ##\n~x\n",
    10: "",
}
_AFTER = {0: "\nBT\n", 1: "\nGPO : 1977 O - 225-5358\n", 2: "\nBT\n", 4: "\nDate: 6-8-77\nTitle: ESCAPE\n"}


def _sql_text(s: str) -> str:
    return " || chr(10) || ".join(f"'{x}'" for x in s.split("\n")) if s else "''"


def _case(parts: dict[int, str]) -> str:
    return "CASE doc_no % 11 " + " ".join(f"WHEN {k} THEN {_sql_text(v)}" for k, v in parts.items()) + " ELSE '' END"


#: The same with form lines around the body by doc_no % 11, and a last page of noise for each source (its doc_no is negative).
FORMS = f"""
SELECT source_stem, page_no, doc_no, conf_tenths,
  CASE WHEN page_no = 1 AND doc_no % 2 = 0 THEN 'COVER SHEET' || chr(10) ELSE '' END || {_case(_BEFORE)} || raw_text || {_case(_AFTER)} AS raw_text
FROM ({PAGES}) p
UNION ALL SELECT source_stem, CAST(max(page_no) + 1 AS INT), -1 - min(doc_no), 0, '~~ 12 %% ** (( )) __ ##' || chr(10) || '~x' FROM ({PAGES}) p GROUP BY source_stem"""


#: Ranges of doc_id within a source: each is numbered by itself, so that a large source is not one task.
RANGES = 128


def _number_pages(spark: SparkSession, sf_dir: str) -> str:
    """A view of the rows of PAGES: a page's number is its place in its range and the rows of the ranges before."""
    d = read(spark, sf_dir, "documents")
    cuts = sorted(set(d.agg(F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)])).first()[0] or []))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < F.col("doc_id")))
    # in a struct, a source that is null is a key like others
    d = d.select("*", F.struct("source").alias("__source"), F.when(F.col("doc_id").isNull(), 0).otherwise(at).alias("__range"))
    upto = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("__source", "__range").agg(F.count("*").alias("k")).select("__source", "__range", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__source", "__range").orderBy("doc_id"))
    # merged, not broadcast: both sides are dealt and sorted by these keys already
    d.withColumn("__place", place).join(before.hint("merge"), ["__source", "__range"]).createOrReplaceTempView("numbered_documents")
    return PAGES.replace("row_number() OVER (PARTITION BY source ORDER BY doc_id)", "__before + __place").replace("FROM documents", "FROM numbered_documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rows with quality columns; confidence stays in tenths next to its double."""
    from ..operators.quality import assign_buckets, with_text_measures

    p = spark.sql(_number_pages(spark, sf_dir)).withColumn("ocr_confidence", F.col("conf_tenths") / 10)
    return assign_buckets(with_text_measures(p), 60.0)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "documents")
    last = "SELECT source AS source_stem, count(*) AS page_no, min(doc_id) AS doc_no FROM documents GROUP BY source"
    sql = FORMS.replace(PAGES, _number_pages(spark, sf_dir), 1).replace(PAGES, last)
    return spark.sql(sql).withColumn("bucket", F.when(F.col("doc_no") % 17 == 3, "skipped").otherwise("clean"))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned pages with their documents: each stage is written once and read by what follows."""
    from ..operators.clean import clean_pages
    from ..operators.group import group_pages
    from ..sources.tables import staged

    return staged(group_pages(staged(clean_pages(forms(spark, sf_dir)), "clean")), "grouped")


#: Assistant turns as answers under test: some cite a hit, some a stranger, some refuse.
ANSWERS = """
SELECT CAST(conv_id AS VARCHAR(40)) || '-' || CAST(turn AS VARCHAR(40)) AS id, conv_id % 7 = 0 AS refused,
  text || CASE turn % 6 WHEN 1 THEN ' [doc-' || CAST(conv_id % 5 AS VARCHAR(40)) || ', p.3]' WHEN 3 THEN ' [stranger, pages 12]'
    WHEN 5 THEN ' The excerpts do not contain this.' ELSE CASE WHEN conv_id % 3 = 0 THEN ' They cannot answer it [doc-1, p. 4].' ELSE '' END END AS answer,
  array[named('doc-' || CAST(conv_id % 5 AS VARCHAR(40))), named('doc-1')] AS hits, conv_id % 5 AS bucket, turn
FROM conversations WHERE role = 'assistant'"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "conversations")
    sql = ANSWERS.replace("array[", "array(").replace("')] AS hits", "')) AS hits").replace("named(", "named_struct('score', CAST(0.5 AS DOUBLE), 'doc_id', ")
    a = spark.sql(sql)
    expected = F.when(F.col("bucket") == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("doc-"), F.pmod("bucket", F.lit(3)).cast("string"))))
    behavior = F.when(F.pmod("bucket", F.lit(4)) == 3, "refuse").otherwise("answer")
    return a.withColumns({"expected_doc_ids": expected, "expected_behavior": behavior})
