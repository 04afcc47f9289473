"""Shared helpers: tables, written intermediates in the shared folder, Arrow mapping."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            base = set_already.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="papyria-")
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/papyria/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written() -> None:
    """Delete every intermediate of this session; call it once results are stored. Also runs at exit."""
    while _written:
        spark, path = _written.pop()
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session is gone
            return


atexit.register(drop_written)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df to the shared folder once and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes of one Arrow batch, however long its texts are (one row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about most_bytes at most; a single longer row comes alone."""
    rows = batch.num_rows
    if rows <= 1 or batch.nbytes <= most_bytes:
        if rows:
            yield batch
        return
    half = rows // 2
    yield from slices(batch.slice(0, half), most_bytes)
    yield from slices(batch.slice(half), most_bytes)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Maximal runs of [^\\x20\\x09-\\x0D]; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


#: Bits of a membership filter: 8 MB when broadcast, whatever the input.
FILTER_BITS = 26


def with_maybe(docs: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """docs plus __maybe: false if the id is surely not in ids (one column of longs), so the row needs no shuffled join.

    ids set bits by a hash in 2048 bitmaps of a fixed size, which are broadcast; a null id is in no set."""
    at = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    p = at(ids.columns[0])
    marks = ids.where(F.col(ids.columns[0]).isNotNull()).select(p.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    here = at(F.col(id_column).cast("long"))
    place = F.bitmap_bit_position(here).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0, F.lit(False))
    return docs.join(F.broadcast(marks), F.bitmap_bucket_number(here) == F.col("__bucket"), "left").withColumn("__maybe", bit & F.col(id_column).isNotNull()).drop("__bucket", "__bits")


def join_to_unique(left: DataFrame, right: DataFrame, on: list[str], how: str, hot_share: int = 20_000) -> DataFrame:
    """left joined (inner or left) to right, which has one row for each key. Both should be stored.

    Keys of more than a hot_share-th of the rows of left are at most hot_share; they are broadcast, and all other keys are few rows
    each, so no task of the merge join gets a large part of left."""
    counts = stored(left.groupBy(*on).agg(F.count("*").alias("__n")), "key-counts")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("__n") > max(1, total // hot_share)).drop("__n"))
    some, few = right.join(hot, on, "left_semi"), left.join(hot, on, "left_semi")
    return few.join(F.broadcast(some), on, how).unionByName(left.join(hot, on, "left_anti").join(right.hint("merge"), on, how))
