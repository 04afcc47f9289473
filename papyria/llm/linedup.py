"""Line dedup over levelled sorted runs of line hashes.

A LineStore keeps runs of (h1, h2, n_docs, first_doc) in the shared folder: 128 bits of a line key's hash, the number of
documents with that key, and the smallest id among them. Every run is bucketed by its hash and sorted in each bucket.
A new batch is counted into the same buckets and merge-anti-joined with the runs, one after the other, without an exchange or
a sort of the runs: keys that no run has become the batch's own run, and what the batch adds to keys that a run has
already becomes a run of increments. `fanout` runs of a level are compacted into one of the next, so a key is
rewritten a logarithmic number of times, and a batch meets a logarithmic number of runs.

line_dedup deals the documents into batches by their ids, adds each to a store, and drops the lines whose key has
reached min_docs in the end. A key that very many documents hold meets them by a broadcast (there are few such keys), the
others by a merge join, so no task gets all documents of one line; a text without such a line is not shuffled.

Defined results: a null or empty text is one empty line; a line that is blank after stripping has an empty key and
is never dropped when min_chars >= 1; rows that share a doc_id, or have none, count as documents of their own; the text
keeps its own \\r or other white space; a very long text takes n log n time in its lines; an empty table gives no
rows. With keep_first the rows of the smallest doc_id keep a shared line, and a null id comes last. Columns of any other
name pass through deduped, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, drop_path, shared_path, stored, with_maybe

KEY = ["h1", "h2"]
#: Keys held by more than this share of all (document, key) pairs: 20,000 keys at most, so they can be broadcast.
HOT_SHARE = 20_000
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """A bucket of one file is known to be sorted, while the block runs."""
    before = spark.conf.get(_ORDERED, "false")
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def line_keys(text: Column, min_chars: int) -> Column:
    """array<struct<h1, h2, at array<int>>>: the distinct keys of a text's lines and the places of their lines.

    Lines are sorted by hash, so that equal ones are neighbours."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("i")))
    hashed = F.transform(F.filter(lines, lambda x: F.length(x["k"]) >= min_chars), lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(7), x["k"]).alias("h2"), x["i"].alias("i")))

    def grouped(s: Column) -> Column:
        other = lambda j: (F.get(s, j)["h1"] != F.get(s, j - 1)["h1"]) | (F.get(s, j)["h2"] != F.get(s, j - 1)["h2"])
        none = F.array().cast("array<int>")
        first = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.size(s), F.lit(1)) - 1), lambda j: (j == 0) | other(j))).otherwise(none)

        def groups(f: Column) -> Column:
            return F.transform(f, lambda j, n: F.struct(F.get(s, j)["h1"].alias("h1"), F.get(s, j)["h2"].alias("h2"), F.transform(F.slice(s, j + 1, F.coalesce(F.get(f, n + 1), F.size(s)) - j), lambda x: x["i"]).alias("at")))

        # an array of one element binds its value to a name, so it is made once
        return F.transform(F.array(first), groups)[0]

    return F.transform(F.array(F.sort_array(hashed)), grouped)[0]


class LineStore:
    """Levelled runs under one path."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.path = path or shared_path(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        """A run as a bucketed table of its own path; the catalog entry is all that the session keeps of it."""
        self.made += 1
        name = f"papyria_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/run={self.made}").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        path = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, path)

    def _add(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[str]:
        return [n for level in reversed(self.levels) for n in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h1, h2, ...) whose key is in no run yet: merge anti-joins with the runs."""
        for name in self.runs():
            keys = keys.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch of (h1, h2, doc_id), one row for each document and key. Returns the batch's run of fresh keys."""
        with _sorted_buckets(self.spark):
            counted = self._write(keys.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")))
            batch, known = self.spark.table(counted), bool(self.runs())
            if not known:
                new = counted
            else:
                new = self._write(self.fresh(batch))
                more = self._write(batch.join(self.spark.table(new).select(*KEY).hint("merge"), KEY, "left_anti"))
                self._add(more, 0)
                self._drop(counted)
            self._add(new, 0)
            out = self.spark.table(new)
            if len(self.levels[0]) >= self.fanout:
                out = stored(out, "fresh-lines")  # the run itself may be compacted away
            self.compact()
        return out

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._add(self._write(self._merged(self._union(old))), level + 1)
                for name in old:
                    self._drop(name)
            level += 1

    def _union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for n in names[1:]:
            out = out.unionByName(self.spark.table(n))
        return out

    def totals(self) -> DataFrame:
        """h1, h2, n_docs, first_doc of every key."""
        return self._merged(self._union(self.runs()))

    def close(self) -> None:
        for level in self.levels:
            while level:
                self._drop(level.pop())


def dedup_batch(store: LineStore, docs: DataFrame) -> DataFrame:
    """One batch of an endless corpus: the lines whose key no earlier batch had, each by its first holder.

    Returns doc_id, i (place of the line in its document), h1, h2, and adds the batch's keys to the runs."""
    lines = stored(docs.select("doc_id", F.inline(line_keys(F.col("text"), 1))), "batch-lines")
    first = lines.groupBy(*KEY).agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", F.array_min("at").alias("i"))).alias("f"))
    new = store.add(lines.select("doc_id", *KEY))
    return stored(first.join(new.select(*KEY).hint("merge"), KEY, "left_semi").select("f.doc_id", "f.i", *KEY), "batch-fresh")


def without_places(lines: Column, gone: Column) -> Column:
    """lines but those at the ascending places gone: what lies between them is cut out, in linear time."""
    start = lambda j: F.coalesce(F.get(gone, j - 1) + 1, F.lit(0))
    end = lambda j: F.coalesce(F.get(gone, j), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.slice(lines, start(j) + 1, end(j) - start(j))))


def _marked(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool, batches: int, fanout: int) -> DataFrame:
    """docs plus __ld_lines (the text's lines) and __ld_gone (ascending places of those that go; null: none)."""
    spark = docs.sparkSession
    # the number of a row is written with it, so it stays the same whichever task reads it again
    rows = docs.withColumns({"__ld_row": F.monotonically_increasing_id(), "__ld_keys": line_keys(F.col("text"), min_chars), "__ld_batch": F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")})
    path = shared_path(spark, "line-keys")
    rows.write.option("compression", "zstd").partitionBy("__ld_batch").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    pairs = rows.select("__ld_batch", "__ld_row", "doc_id", F.inline("__ld_keys"))
    store = LineStore(spark, fanout=fanout)
    for i in range(batches):
        store.add(pairs.where(F.col("__ld_batch") == i).select("doc_id", *KEY))
    totals = stored(store.totals(), "line-totals")
    store.close()
    every = totals.agg(F.sum("n_docs")).first()[0] or 0
    common = totals.where(F.col("n_docs") >= min_docs)
    hot = F.col("n_docs") > every // HOT_SHARE
    few, rest = F.broadcast(common.where(hot)), common.where(~hot)
    by_hot = pairs.join(few, KEY)
    by_rest = with_maybe(pairs, "h1", rest.select("h1")).where("__maybe").drop("__maybe").join(rest.hint("merge"), KEY)
    hits = by_hot.unionByName(by_rest)
    if keep_first:
        hits = hits.where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = stored(hits.groupBy("__ld_row").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("__ld_gone")), "line-places")
    d = with_maybe(rows.drop("__ld_keys", "__ld_batch"), "__ld_row", gone.select("__ld_row"))
    sure = d.where("not __maybe").withColumn("__ld_gone", F.lit(None).cast("array<int>"))
    touched = d.where("__maybe").join(gone.hint("merge"), "__ld_row", "left")
    d = sure.unionByName(touched).withColumn("__ld_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return d.drop("__maybe", "__ld_row")


def _kept() -> Column:
    return F.array_join(F.when(F.col("__ld_gone").isNull(), F.col("__ld_lines")).otherwise(without_places(F.col("__ld_lines"), F.col("__ld_gone"))), "\n")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, batches: int = 3, fanout: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped (long) and kept (string: the lines that stay, joined by \\n) of every row.

    A line goes if its key has min_chars code points or more and is in min_docs documents or more. With
    keep_first, the document of the smallest id keeps it."""
    d = _marked(docs.select("doc_id", "text"), min_docs, min_chars, keep_first, batches, fanout)
    return d.select("doc_id", F.size("__ld_lines").cast("long").alias("n_lines"), F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long").alias("n_dropped"), _kept().alias("kept"))


def deduped(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = True, batches: int = 3, fanout: int = 4) -> DataFrame:
    """docs with only the lines that stay in text, and n_chars, if there is such a column, counted anew. No row goes."""
    d = _marked(docs, min_docs, min_chars, keep_first, batches, fanout).withColumn("text", _kept())
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)
