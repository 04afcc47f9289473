"""Repairs of grouped documents: reclassification and merges from specification tables.

Specifications are small hand-written tables (one row for each document to repair) and are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

WITHHELD = "[WITHHELD - FOIA 4-750]"
SPEC = "parent string, absorbed array<string>, placeholders array<int>, kind string, first_template string, note string"


def reclassify(docs: DataFrame, pages: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs and pages with the kinds of (doc_id, new_kind), and the ids of kinds that no document has."""
    k = F.broadcast(kinds.groupBy("doc_id").agg(F.max("new_kind").alias("new_kind")))  # an id that is named twice counts once
    d = docs.join(k, "doc_id", "left").withColumn("kind", F.coalesce("new_kind", "kind")).drop("new_kind").select(*docs.columns)
    known = k.join(docs.select("doc_id"), "doc_id", "left_semi")
    p = pages.join(F.broadcast(known), "doc_id", "left").withColumn("doc_kind", F.coalesce("new_kind", "doc_kind")).drop("new_kind").select(*pages.columns)
    return d, p, kinds.join(docs.select("doc_id"), "doc_id", "left_anti").select("doc_id")


def merge_documents(docs: DataFrame, pages: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs and pages after the merges of specs (see SPEC): absorbed documents' pages go to the parent and are numbered
    anew. A parent that is missing is skipped, and so is one that already has exactly these pages, so a second run
    changes nothing."""
    s = specs.join(docs.select(F.col("doc_id").alias("parent"), F.col("page_nos").alias("__had")), "parent")
    each = s.select("parent", "kind", "placeholders", "__had", F.explode("absorbed").alias("doc_id"))
    moved = pages.select("source_stem", "page_no", "doc_id").join(F.broadcast(each), "doc_id")
    w = Window.partitionBy("parent")
    moved = moved.withColumns({"__nos": F.array_sort(F.collect_list("page_no").over(w)), "__i": F.row_number().over(w.orderBy("source_stem", "page_no")), "__n": F.count("*").over(w)})
    moved = moved.where(F.col("__nos") != F.col("__had"))
    new = moved.select("source_stem", "page_no", F.col("parent").alias("__id"), F.col("kind").alias("__kind"), "__i", "__n", F.when(F.array_contains("placeholders", F.col("page_no")), WITHHELD).alias("__hold"))
    p = pages if "inline_placeholder" in pages.columns else pages.withColumn("inline_placeholder", F.lit(None).cast("string"))
    hit = F.col("__id").isNotNull()
    out = p.join(new, ["source_stem", "page_no"], "left").withColumns(
        {
            "doc_id": F.coalesce("__id", "doc_id"),
            "doc_kind": F.coalesce("__kind", "doc_kind"),
            "doc_page_index": F.coalesce("__i", "doc_page_index"),
            "doc_page_count": F.when(hit, F.col("__n").cast("int")).otherwise(F.col("doc_page_count")),
            "inline_placeholder": F.when(hit, F.col("__hold")).otherwise(F.col("inline_placeholder")),
        }
    )
    out = out.select(*p.columns)
    active = moved.groupBy("parent").agg(F.array_sort(F.collect_list("page_no")).alias("page_nos"))
    gone = s.join(F.broadcast(active.select("parent")), "parent", "left_semi").select("parent", F.explode("absorbed").alias("doc_id"))
    cases = docs.join(F.broadcast(gone), "doc_id").groupBy("parent").agg(t.sorted_distinct(F.flatten(F.collect_list("case_nums"))).alias("case_nums"))
    merged = active.join(s.select("parent", "kind", "first_template", "note", "placeholders"), "parent").join(cases, "parent", "left")
    source = docs.select(F.col("doc_id").alias("parent"), "source_stem")
    merged = merged.join(source, "parent").select(
        "source_stem", F.col("parent").alias("doc_id"), "kind", "page_nos", F.size("page_nos").alias("page_count"), "first_template", F.coalesce("case_nums", t.none()).alias("case_nums"), "note",
        F.array_sort("placeholders").alias("withheld_page_nos"),
    )
    dead = gone.select("doc_id").unionByName(active.select(F.col("parent").alias("doc_id"))).distinct()
    return docs.join(F.broadcast(dead), "doc_id", "left_anti").unionByName(merged, allowMissingColumns=True), out
