"""Page numbers by ranges of a source against the row numbers of the SQL."""

import duckdb
from pyspark.sql import functions as F

from papyria.plans import fixtures as fx


def tables(spark, path):
    d = spark.range(1500).select((F.col("id") * 7 - 3000).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 11 == 3, None).when(F.col("id") % 9 == 0, "b").otherwise("a").alias("source"), F.length(F.col("id").cast("string")).cast("long").alias("n_chars"))
    d.repartition(3).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con


def test_forms_are_those_of_the_sql_and_a_large_source_is_dealt_to_tasks(spark, tmp_path):
    con = tables(spark, tmp_path)
    columns = ["source_stem", "page_no", "doc_no", "conf_tenths", "raw_text"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({fx.FORMS}) f").fetchall(), key=key)
    assert sorted((tuple(r) for r in fx.forms(spark, str(tmp_path)).select(*columns).collect()), key=key) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = fx.pages(spark, str(tmp_path)).where("source_stem = 'a'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) > 1  # one task before


def test_an_empty_table_has_no_pages(spark, tmp_path):
    tables(spark, tmp_path)
    spark.read.parquet(f"{tmp_path}/documents.parquet").where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fx.pages(spark, f"{tmp_path}/none").count() == 0 and fx.forms(spark, f"{tmp_path}/none").count() == 0
