"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio (DataFrame functions only).

Two multinomials over hashed word unigrams and bigrams are counted: the raw corpus (every document) and the
trusted target (documents labelled good). A document's score is the mean over its n-grams of
log p_target - log p_raw; it is kept if the score reaches a fixed threshold. The number of buckets grows with the
square root of the corpus's bytes, as the different n-grams of a language do in good part (Heaps' law), so how many share
a bucket stays alike. Counts are summed in each task first, so what is shuffled is one row for each task and bucket.
The weights are a table that n-grams are joined with: broadcast up to BROADCAST buckets, shuffled beyond, with equal results.

Defined results: a null or blank text has no words, score 0 and fails the base rule (fewer than min_words);
repeated doc_ids are separate rows; without any labelled good document the verdict is true for all; without
documents the result is empty. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, stored, with_maybe, words_of

#: Buckets: at least LEAST, and PER_ROOT for each root of a byte; sf0.1, where the threshold was set, has about LEAST.
LEAST, PER_ROOT = 1 << 16, 12
#: The weights of so many buckets are broadcast (some 170 MB), and so many ids of target documents.
BROADCAST = 1 << 22
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.1


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text, words, and wh: a 64-bit hash of each word; and the columns to keep."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep).withColumn("words", words_of(F.col("text"))).withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))


def _window(k: int) -> Column:
    """Hashes of all windows of k words."""
    n = F.size("wh") - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get("wh", i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _ngrams(buckets: int) -> Column:
    """Bucket numbers of all words and word pairs."""
    n = F.lit(buckets).cast("long")
    return F.transform(F.concat("wh", _window(2)), lambda h: F.pmod(h, n))


def bucket_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(LEAST, math.isqrt(PER_ROOT * PER_ROOT * size))


def ngram_weights(docs: DataFrame, target_ids: DataFrame, buckets: int, broadcast_ids: int = BROADCAST) -> DataFrame:
    """b, w: log p_target - log p_raw of each bucket that docs fill, both with add-one smoothing over all buckets.

    target_ids: doc_id, distinct, of any number; up to broadcast_ids of them are broadcast (32 MB). Beyond that they are joined,
    and documents that are surely not among them stay out of the join."""
    ids = stored(target_ids.select(F.col("doc_id").alias("__id")), "target-ids").withColumn("__t", F.lit(1))
    docs, found = docs.select("doc_id", "text"), F.col("doc_id") == F.col("__id")
    if ids.count() <= broadcast_ids:
        marked = docs.join(F.broadcast(ids), found, "left").select("doc_id", "text", F.coalesce("__t", F.lit(0)).alias("t"))
    else:
        d = with_maybe(docs, "doc_id", ids.select("__id"))
        maybe = d.where("__maybe").join(ids.hint("merge"), found, "left").select("doc_id", "text", F.coalesce("__t", F.lit(0)).alias("t"))
        marked = maybe.unionAll(d.where("not __maybe").select("doc_id", "text", F.lit(0).alias("t")))
    grams = _hashed(marked, "t").select("t", F.explode(_ngrams(buckets)).alias("b"))
    counts = stored(grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good")), "ngram-counts")
    raws, goods = counts.agg(F.sum("raw"), F.sum("good")).first()
    if not goods:
        return counts.select("b", F.lit(0.0).alias("w"))
    ratio = F.log((F.col("good") + 1) / float(goods + buckets)) - F.log((F.col("raw") + 1) / float(raws + buckets))
    return counts.select("b", ratio.alias("w"))


def _repeated(d: DataFrame) -> DataFrame:
    """Adds __rep: the places of the 3-word windows found twice or more in a text.

    The windows are sorted, so that equal ones are neighbours: n log n in the length of one text. Texts of under
    2 ** 20 windows sort plain longs, the upper hash bits with the place below, and compare whole hashes of
    neighbours; longer texts sort pairs."""
    none = F.array().cast("array<int>")
    d = d.withColumn("__w3", _window(3)).withColumn("__some", F.size(F.array_distinct("__w3")) < F.size("__w3")).withColumn("__long", F.size("__w3") >= 1 << 20)
    high, low = F.lit(-(1 << 20)), F.lit((1 << 20) - 1)
    packed = F.sort_array(F.transform("__w3", lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform("__w3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__packed", F.when(F.col("__some") & ~F.col("__long"), packed)).withColumn("__pairs", F.when(F.col("__some") & F.col("__long"), pairs))
    place = lambda x: x.bitwiseAND(low).cast("int")

    def twin(x, other):
        near = x.bitwiseAND(high) == other.bitwiseAND(high)
        return F.coalesce(near & (F.get("__w3", place(x)) == F.get("__w3", place(other))), F.lit(False))

    fast = F.transform(F.filter("__packed", lambda x, i: twin(x, F.get("__packed", i + 1)) | twin(x, F.get("__packed", i - 1))), place)
    same = lambda x, i: F.coalesce(x["h"] == F.get("__pairs", i)["h"], F.lit(False))
    slow = F.transform(F.filter("__pairs", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"])
    return d.withColumn("__rep", F.coalesce(fast, slow, none))


def base_counts(d: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to what _hashed returns."""
    d = _repeated(d).withColumn("__lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != ""))
    return d.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", WS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("__rep", lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("n_repeat_words"),
    )


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int | None = None, threshold: float = THRESHOLD, min_words: int = 50, repeat_pct: int = 50, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, base counts, ngram_score double, base_failed, kept."""
    buckets = bucket_count(docs) if buckets is None else buckets
    weights = ngram_weights(docs, good_ids(labels), buckets, broadcast).hint("broadcast" if buckets <= broadcast else "merge")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = base_counts(_hashed(docs)).select(F.monotonically_increasing_id().alias("__row"), *columns, _ngrams(buckets).alias("__g"))
    # the counts go with a row's n-grams, so that the row is put together by one aggregation, mostly within its task
    grams = d.select("__row", *columns, F.explode_outer("__g").alias("b"))
    d = grams.join(weights, "b", "left").groupBy("__row", *columns).agg(F.sum("w").alias("__total"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))
    d = d.select(*columns, F.when(F.col("n_words") > 0, F.col("__total") / (2 * F.col("n_words") - 1)).otherwise(0.0).alias("ngram_score"), failed.alias("base_failed"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("ngram_score") >= threshold))
