"""Substring dedup: every word covered by a window of words that also starts earlier is removed.

Pass 0 writes the texts, as words joined by one blank, in compressed blocks of a few MB, so that every later pass
sees the same blocks. Pass 1: each block makes a partition sketch, sparse and saturating at two, of the count-min cells of its
windows; sketches are cut by cell range into shards, merged for each shard, and the answer to a block is one bit for
each cell that it named: is the estimated count two or more? A cell overestimates, so no repeated window is
lost. Pass 2: only windows so estimated are grouped exactly, by 128 bits of two independent hashes of their bytes; each
block names each distinct window once with its first document, and gets back one bit: is that the first of all?
Pass 3 removes words and digests what is left.

The number of shards follows the number of windows, so a merging task's memory does not grow; a window of a third of all
documents is one entry for each block. Windows of equal hashes count as equal: at 10 ** 13 different windows two share their 128
bits with a chance of 10 ** -13.

Defined results: a null or blank text has no words and keeps ''; texts of fewer words than the window lose nothing; rows
without doc_id come after all others; rows that share a doc_id, or have none, are separate documents in the order of a hash of
their words, so the result does not depend on how the input is cut into files; a very long text is one block and read whole; an
empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, shared_path, slices, small_batches
from .windows import Buffer, open_ints, pack_ints

#: Windows for each shard and cells for each window: a unique window is taken for a repeated one about once in 8.
SHARD_WINDOWS, CELLS = 1 << 22, 8


def write_blocks(docs: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """block long, windows long, ids binary (see Ids), texts binary; documents ascend within a block."""
    kinds = pa.schema([("block", pa.int64()), ("windows", pa.int64()), ("ids", pa.binary()), ("texts", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[tuple[bool, int, int], bytes, int]] = []
        size = 0

        def block() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(t + b"\n" for _, t, _ in held))
            cols = (number, sum(max(0, n - window + 1) for _, _, n in held), Ids.packed([k for k, _, _ in held]), packed)
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds.types)], schema=kinds)

        for batch in (s for b in batches for s in slices(b, block_bytes)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                t = b" ".join(words)
                held.append(((doc is None, doc or 0, xxhash.xxh64_intdigest(t)), t, len(words)))
                size += len(t)
                if size >= block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    path = shared_path(docs.sparkSession, "blocks")
    schema = "block long, windows long, ids binary, texts binary"
    map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), cut, schema).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


class Ids:
    """A block's documents: id, whether there is none, and the hash of the words that orders equal ids."""

    def __init__(self, packed: bytes):
        n = len(packed) // 17
        self.null = np.frombuffer(packed, np.uint8, n).astype(bool)
        self.id, self.tie = np.frombuffer(packed, "<i8", n, n), np.frombuffer(packed, "<u8", n, 9 * n)

    @staticmethod
    def packed(keys: list[tuple[bool, int, int]]) -> bytes:
        null, ids, ties = zip(*keys)
        return np.array(null, np.uint8).tobytes() + np.array(ids, "<i8").tobytes() + np.array(ties, "<u8").tobytes()

    def part(self, used: np.ndarray) -> bytes:
        return self.null[used].astype(np.uint8).tobytes() + self.id[used].tobytes() + self.tie[used].tobytes()


def _shard_bounds(shards: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(shards, np.arange(n + 1))


class Block:
    """The windows of a block and the two orders in which it names them."""

    def __init__(self, texts: bytes, window: int, shards: int):
        self.buffer = Buffer(zstandard.ZstdDecompressor().decompress(texts))
        self.window, self.shards = window, shards
        self.first, self.last, self.many = self.buffer.window_starts(window)
        self.h1 = self.buffer.hashes(self.first, self.last) if len(self.first) else np.zeros(0, np.uint64)

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (shard, cell) as one ascending number, its place for each window, counts, and bounds of shards."""
        n = np.uint64(self.shards * SHARD_WINDOWS * CELLS)
        # the upper bits of a product spread hashes evenly over any number of cells
        cell = (self.h1 >> np.uint64(16)) % n
        names, place, counts = np.unique(cell, return_inverse=True, return_counts=True)
        return names, place, counts, np.searchsorted(names, np.arange(self.shards + 1, dtype=np.uint64) * np.uint64(SHARD_WINDOWS * CELLS))

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Numbers of the windows estimated repeated."""
        names, place, _, bounds = self.cells()
        flag = np.zeros(len(names), bool)
        for s, bits in answers.items():
            a, b = bounds[s], bounds[s + 1]
            flag[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a))
        return np.flatnonzero(flag[place])

    def named(self, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the windows in some: shard and both hashes of each distinct one, ascending; its first window; the group of each."""
        h2 = self.buffer.hashes(self.first[some], self.last[some], 1) if len(some) else np.zeros(0, np.uint64)
        shard = ((h2 >> np.uint64(8)) % np.uint64(self.shards)).astype(np.int64)
        h1 = self.h1[some]
        order = np.lexsort((some, h2, h1, shard))
        a, b = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # the shard follows from the second hash
        return shard[order][new], a[new], b[new], some[order][new], order, np.cumsum(new) - 1

    def text_of(self, windows: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.cumsum(self.many), windows, side="right")


def _answers(sent: pd.DataFrame, bits: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"block": sent["block"], "shard": sent["shard"], "bits": bits})


def merge_sketches(sent: pd.DataFrame) -> pd.DataFrame:
    """One shard: cells named by any block add up; each block learns which of its cells reach two."""
    count = np.zeros(SHARD_WINDOWS * CELLS, np.uint8)
    for body, twice in zip(sent["body"], sent["more"]):
        cells = open_ints(body, ascending=True)
        count[cells] = np.minimum(count[cells] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cells)), 2)
    return _answers(sent, [np.packbits(count[open_ints(body, ascending=True)] >= 2).tobytes() for body in sent["body"]])


def merge_windows(sent: pd.DataFrame) -> pd.DataFrame:
    """One shard: of each window, the entry of the first document is the first (of equal rows, that of the earlier block)."""
    h1, h2, docs, owner, sizes = [], [], [], [], []
    for i, (body, more) in enumerate(zip(sent["body"], sent["more"])):
        n, m = struct.unpack_from("<II", more)
        ids, place = Ids(more[8 : 8 + n]), open_ints(more[8 + n + m :]).astype(np.int64)
        h1.append(open_ints(body, ascending=True))
        h2.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(more[8 + n : 8 + n + m]), "<u8"))
        docs.append((ids.null[place], ids.id[place], ids.tie[place]))
        owner.append(np.full(len(place), i, np.int32))
        sizes.append(len(place))
    a, b, o = np.concatenate(h1), np.concatenate(h2), np.concatenate(owner)
    null, doc, tie = (np.concatenate(c) for c in zip(*docs))
    rank = np.argsort(np.argsort(sent["block"].to_numpy(), kind="stable"))
    order = np.lexsort((rank[o], tie, doc, null, b, a))
    first = np.ones(len(order), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.zeros(len(order), bool)
    out[order] = first
    ends = np.cumsum(sizes).tolist()
    return _answers(sent, [np.packbits(out[y - x : y]).tobytes() for x, y in zip(sizes, ends)])


_SENT = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("body", pa.binary()), ("more", pa.binary())])
_SENT_SQL, _BACK_SQL = "shard long, block long, body binary, more binary", "block long, shard long, bits binary"


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64]), _SENT.types)], schema=_SENT)


def substring_dedup(docs: DataFrame, window: int = 20, block_bytes: int = 4 << 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept: the words that stay, joined by one blank)."""
    blocks = write_blocks(docs, window, block_bytes)
    spark = docs.sparkSession
    shards = max(1, -(-(blocks.agg(F.sum("windows")).first()[0] or 0) // SHARD_WINDOWS))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, texts in zip(batch.column("block").to_pylist(), batch.column("texts")):
                b = Block(texts.as_py(), window, shards)
                names, _, counts, bounds = b.cells()
                yield from _rows([(s, number, pack_ints(names[x:y] - np.uint64(s * SHARD_WINDOWS * CELLS), ascending=True), np.packbits(counts[x:y] > 1).tobytes()) for s, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if y > x])

    def answers(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias(name)).withColumnRenamed("block", f"{name}_block")

    def read_answers(cell) -> dict[int, bytes]:
        return {x["shard"]: x["bits"] for x in cell or []}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, texts, one in zip(*(batch.column(c) for c in ("block", "ids", "texts", "one"))):
                b = Block(texts.as_py(), window, shards)
                shard, h1, h2, where, _, _ = b.named(b.repeated(read_answers(one.as_py())))
                owner, all_ids = b.text_of(where), Ids(ids.as_py())
                bounds, out = _shard_bounds(shard, shards), []
                for s, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if y > x:
                        used, rank = np.unique(owner[x:y], return_inverse=True)
                        named, second = all_ids.part(used), zstandard.ZstdCompressor(level=1).compress(h2[x:y].astype("<u8").tobytes())
                        out.append((s, number.as_py(), pack_ints(h1[x:y], ascending=True), struct.pack("<II", len(named), len(second)) + named + second + pack_ints(rank)))
                yield from _rows(out)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text
    kinds = pa.schema(fields)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, one, two in zip(*(batch.column(c) for c in ("ids", "texts", "one", "two"))):
                b = Block(texts.as_py(), window, shards)
                shard, _, _, where, order, group = b.named(some := b.repeated(read_answers(one.as_py())))
                bounds, first = _shard_bounds(shard, shards), np.zeros(len(where), bool)
                for s, bits in read_answers(two.as_py()).items():
                    x, y = bounds[s], bounds[s + 1]
                    first[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(y - x))
                gone = np.ones(len(some), bool)  # in the order of named
                gone[np.flatnonzero(np.diff(group, prepend=-1))] = ~first
                change = np.zeros(len(b.buffer.starts) + 1, np.int64)
                dead = b.first[some[order][gone]]
                np.add.at(change, dead, 1)
                np.add.at(change, dead + window, -1)
                stays = np.cumsum(change[:-1]) == 0
                yield _digests(b.buffer, Ids(ids.as_py()), stays, with_text, kinds)

    small_batches(spark)
    sent = blocks.select("block", "texts").mapInArrow(sketch, _SENT_SQL)
    one = answers(sent.groupBy("shard").applyInPandas(merge_sketches, _BACK_SQL), "one")
    path = shared_path(spark, "estimates")
    one.write.option("compression", "zstd").parquet(path)
    one = spark.read.schema(one.schema).parquet(path)
    asked = blocks.select("block", "ids", "texts").join(one, F.col("block") == F.col("one_block"), "left")
    two = answers(asked.select("block", "ids", "texts", "one").mapInArrow(ask, _SENT_SQL).groupBy("shard").applyInPandas(merge_windows, _BACK_SQL), "two")
    done = blocks.select("block", "ids", "texts").join(one, F.col("block") == F.col("one_block"), "left").join(two, F.col("block") == F.col("two_block"), "left")
    return done.select("ids", "texts", "one", "two").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def _digests(buffer: Buffer, ids: Ids, stays: np.ndarray, with_text: bool, kinds: pa.Schema) -> pa.RecordBatch:
    bounds = buffer.first_word.tolist()
    removed = np.concatenate(([0], np.cumsum(~stays))).tolist()
    names = [None if z else d for z, d in zip(ids.null.tolist(), ids.id.tolist())]
    starts, ends = buffer.starts, buffer.ends
    rows = []
    for doc, x, y in zip(names, bounds[:-1], bounds[1:]):
        gone = removed[y] - removed[x]
        if gone == y - x:
            text = b""
        elif not gone:
            text = buffer.data[starts[x] : ends[y - 1]]
        else:  # runs of words that stay are whole byte ranges
            edge = np.flatnonzero(np.diff(stays[x:y].astype(np.int8), prepend=0, append=0))
            text = b" ".join(buffer.data[starts[x + a] : ends[x + b - 1]] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
        rows.append((doc, y - x, gone, hashlib.sha256(text).hexdigest()) + (text.decode("utf-8", "replace"),) * with_text)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)
