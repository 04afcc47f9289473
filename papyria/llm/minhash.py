"""MinHash near-dedup: links between word-shingle sets, and their connected components.

1. Each text becomes a set of 64-bit shingle hashes; `bands * rows` minima of strongly universal hashes (the upper half of
   a * x + b mod 2 ** 64, of 32-bit x) make `bands` band keys. Documents of equal sets are one class, named by its
   smallest doc_id; from here on only classes take part, so a group of exact copies of any size is one node.
2. In each band bucket every class is compared with the smallest class of the bucket, on full sets. A bucket of any size costs a
   comparison for each member, streamed past the one set that is held; its members are dealt to several tasks.
3. Buckets whose members are now in one component are done: another link could add nothing. Of the others, all
   pairs are confirmed: their components are candidate clusters, the full sets of a cluster meet once, and links are found by
   counting shared shingles through an index from shingle to member. A cluster of more than `cluster` members is cut into
   blocks, and each pair of blocks is confirmed in a task of its own, so no task holds more than two blocks and no link is lost.
4. Confirmed links give the components, by alternating large-star and small-star. A signature's estimate is never used to
   refuse a pair: it could lose a link.

A pair is missed only if it shares no band, and no chain of links joins it otherwise: (1 - 0.85 ** 5) ** 36 = 7e-10 at a
similarity of 0.85, 7e-7 at 0.8.

Defined results: null, empty and blank texts have no shingle, are linked with nothing and are kept; a text of fewer
words than k is one shingle; rows that share a doc_id are one node; a row without doc_id is its own component
(null) and kept; a very long text is read whole; an empty table gives no rows; only doc_id and text are read, other columns
pass through near_dedup unchanged, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, map_arrow, shared_path, slices, stored, with_maybe
from .windows import Buffer, mix

BANDS, ROWS = 36, 5
#: Places that the members of one bucket are dealt to.
SPREAD = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles."""
    data = b"".join(b" ".join((t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()) + b"\n" for t in texts)
    buffer = Buffer(data)
    first, last, many = buffer.window_starts(k, short=True)
    hashes = buffer.hashes(first, last) if len(first) else np.zeros(0, np.uint64)
    ends = np.cumsum(many)
    return [np.unique(hashes[b - m : b]) for b, m in zip(ends.tolist(), many.tolist())]


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7919)
    a, b = rng.integers(0, 1 << 64, (2, n), dtype=np.uint64)
    return a[:, None], b[:, None]


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray, part: int = 1024) -> np.ndarray:
    x = values >> np.uint64(32)
    out = np.full(len(a), (1 << 64) - 1, np.uint64)
    for i in range(0, len(x), part):
        np.minimum(out, (a * x[i : i + part] + b).min(axis=1), out=out)
    return out >> np.uint64(32)  # the smallest upper half is the upper half of the smallest


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in signature.reshape(bands, rows).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (a 128-bit name of the set), bands array<long>."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(bands * rows)
        for batch in (s for x in batches for s in slices(x, 1 << 20)):
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            n = [len(s) for s in sets]
            f1 = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            f2 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            keys = [band_keys(minima(s, a, b), bands, rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=kinds)

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), sign, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that edges a - b reach): alternating large-star and small-star.

    Each round is written to the shared folder, and the one before deleted; only a count and a checksum reach the driver."""
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("m", "a").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        small = large.join(low, F.col("a") == F.col("c")).select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e"))
        old, (now, path) = path, written(small.select(F.greatest("e.x", "e.y").alias("a"), F.least("e.x", "e.y").alias("b")).where("a <> b").distinct())
        drop_path(spark, old)
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
    raise RuntimeError("components did not settle")


def links_within(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links of the components of all pairs with 100 * shared >= percent * union."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(place, kind="stable")
    members, bounds = owner[order], np.concatenate(([0], np.cumsum(np.bincount(place))))
    ends = np.cumsum(sizes)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(m - 1):
        mine = place[ends[i] - sizes[i] : ends[i]]
        lo, n = bounds[mine], bounds[mine + 1] - bounds[mine]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(members[at], minlength=m)
        good = np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared))
        for j in good[good > i].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(ids[i], ids[find(i)]) for i in range(m) if find(i) != i]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


PLACE = "struct<c:bigint,i:int,j:int,o:int>"


def confirmed(docs: DataFrame, members: DataFrame, k: int, percent: int, star: bool) -> DataFrame:
    """Edges a, b. members: node, places (see PLACE): the groups (c, i, j) that the node takes part in, and its order there.

    star: members of order 1 are compared with the one of order 0; otherwise all members with each other."""
    # a filter of a fixed size keeps the texts of documents without a candidate out of the shuffle
    texts = with_maybe(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), "doc_id", members.select("node")).where("__maybe").drop("__maybe")
    texts = texts.join(members.hint("merge"), F.col("doc_id") == F.col("node")).select("node", "places", "text")
    place = pa.list_(pa.struct([("c", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("o", pa.int32())]))
    kinds = pa.schema([("places", place), ("node", pa.int64()), ("shingles", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for x in batches for s in slices(x, 1 << 20)):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column("places").cast(place), batch.column("node"), pa.array(sets, pa.binary())], schema=kinds)

    sets = map_arrow(texts, encode, f"places array<{PLACE}>, node long, shingles binary")
    dealt = sets.select(F.inline("places"), "node", "shingles").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "o", "node")
    edges = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, o, node, shingles in zip(zip(*(batch.column(c).to_pylist() for c in range(3))), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                yield key, o, node, np.frombuffer(shingles.as_py(), np.uint64)

    def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=edges)

    def confirm_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, []
        for key, o, node, s in rows(batches):
            if held is None or key != held[0]:
                held = (key, node, s)
            elif o and similar(s, held[2], percent):
                found.append((node, held[1]))
                if len(found) >= 10_000:
                    yield links(found)
                    found = []
        if found:
            yield links(found)

    def confirm_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(rows(batches), key=lambda r: r[0]):
            nodes: dict[int, np.ndarray] = {}
            for _, _, node, s in group:
                nodes.setdefault(node, s)
            if len(nodes) > 1 and (found := links_within(list(nodes), list(nodes.values()), percent)):
                yield links(found)

    return map_arrow(dealt, confirm_star if star else confirm_all, "a long, b long")


def _blocks(found: DataFrame, cluster: int) -> DataFrame:
    """node, places: the pairs of blocks of its candidate cluster that a node takes part in."""
    all_nodes = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    sizes = found.groupBy("component").agg((F.count("*") + 1).alias("n")).select(F.col("component").alias("cluster"), F.ceil(F.col("n") / cluster).cast("int").alias("g"))
    mine = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda q: F.struct(F.col("cluster").alias("c"), F.least(q, F.col("p")).alias("i"), F.greatest(q, F.col("p")).alias("j"), F.lit(0).alias("o")).cast(PLACE))
    return stored(all_nodes.join(sizes, F.col("component") == F.col("cluster")).withColumn("p", mine).select("node", places.alias("places")), "members")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, cluster: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    sig = stored(signatures(docs, k, bands, rows), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("node")), "classes")
    heads = full.join(classes.select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), "node"), (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")) & (F.col("doc_id") == F.col("node")), "left_semi")
    banded = heads.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select(F.col("band").alias("bucket"), "low")
    ties = stored(banded.join(buckets, F.col("band") == F.col("bucket")).select("band", "node", "low"), "ties")
    # each member meets the smallest of its bucket in one of SPREAD places, and that one goes to the places that are in use
    spread = F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")
    pairs = ties.where("node > low").select("node", F.col("low").alias("c"), spread.alias("i")).distinct()
    place = lambda o: F.struct("c", "i", F.lit(0).alias("j"), F.lit(o).alias("o")).cast(PLACE).alias("p")
    placed = pairs.select("node", place(1)).unionByName(pairs.select("c", "i").distinct().select(F.col("c").alias("node"), place(0)))
    members = stored(placed.groupBy("node").agg(F.collect_list("p").alias("places")), "members")  # bands + SPREAD places at most
    first = stored(confirmed(docs, members, k, percent, star=True), "star-links")
    joined = components(first, "joined")
    # what is left: buckets that hold more than one component
    where = ties.join(joined.select(F.col("node").alias("__n"), "component"), F.col("node") == F.col("__n"), "left").select("band", F.coalesce("component", "node").alias("component"))
    open_bands = where.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(F.col("band").alias("__b"))
    rest = stored(ties.join(open_bands, F.col("band") == F.col("__b"), "left_semi").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "open-ties")
    final = joined
    if not rest.isEmpty():
        second = stored(confirmed(docs, _blocks(components(rest, "candidates"), cluster), k, percent, star=False), "pair-links")
        # what is joined already stays joined, as stars
        final = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second), "linked")
    named = classes.join(final.select(F.col("node").alias("x"), "component"), F.col("node") == F.col("x"), "left").select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.coalesce("component", "node").alias("component"))
    d = sig.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("f1")).alias("f1"), "f2")
    d = d.join(named, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")) & F.col("doc_id").isNotNull(), "left")
    return d.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one row for each kept id and text of repeated rows."""
    gone = stored(near_duplicates(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")), "gone")
    d = with_maybe(docs, "doc_id", gone)  # most documents are surely kept and are not shuffled
    sure, rest = d.where("not __maybe").drop("__maybe"), d.where("__maybe").drop("__maybe")
    return sure.unionByName(rest.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti"))
