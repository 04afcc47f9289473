"""Token ids of texts, and Simple-8b files of ids.

TextEncoder gives the ids that the tokenizers library gives, but runs its BPE on each distinct word once: a byte-level
BPE never joins across a single blank between two words, so a batch of texts is cut there, and only its distinct pieces
are looked up in a bounded cache or encoded. A text where a run of white space touches a cut is cut by the tokenizer's
own pattern instead; one that holds a special token goes to the library whole, as do all texts of a tokenizer of
another kind.

A block is `PS8B`, version, the number of documents, ids and words, a checksum, then doc ids, a null mask, ids per
document and the 64-bit words. The upper four bits of a word are the selector: how many ids of how many bits the
lower 60 bits hold. Selector 0 is an escape: the next word is one raw 64-bit value, for values of over 60 bits.
Every block ends with a document, so it is decoded alone, and one selector at a time for the whole block.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, shared_path, slices, small_batches

#: How a byte-level BPE cuts a text before its merges.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ragged(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places start[i], start[i] + 1, ... of many[i] each, one after the other."""
    total = np.cumsum(many)
    return np.repeat(start - (total - many), many) + np.arange(int(total[-1]) if len(total) else 0)


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    #: Pre-tokens whose ids are kept: some 20 MB.
    MOST = 400_000
    _made: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        # the byte-level form of each byte, as the library writes its vocabulary
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = np.zeros(256, "<u4")
        self.shown[[*plain, *(x for x in range(256) if x not in set(plain))]] = [*plain, *range(256, 324)]
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.parts = regex.compile(_PARTS).findall
        self.space = regex.compile(r"\s").match
        self._forget()

    def _forget(self) -> None:
        self.known, self.known_ids, self.known_ends = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        """One for each Python worker, so that tasks share its cache."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens and where each one's end: the library's BPE on each."""
        parts = pa.concat_arrays([parts])
        offsets = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, 8 * parts.offset) if len(parts) else np.zeros(1, np.int64)
        data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        text, at = self.shown[data].tobytes().decode("utf-32-le"), (offsets - offsets[0]).tolist()
        merge, ids, ends = self.model.tokenize, [], []
        for x, y in zip(at, at[1:]):
            ids += [t.id for t in merge(text[x:y])]
            ends.append(len(ids))
        return np.array(ids, "<u4"), np.array(ends, np.int64)

    def _pretokens(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and start and number of each pre-token's (distinct ones, with the leading blank if there is one)."""
        place = pc.index_in(parts, value_set=self.known)
        missing = parts.filter(pc.is_null(place))
        ids, ends = self._merged(missing)
        at = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = at < 0
        at[fresh] = len(self.known) + np.arange(len(missing))
        all_ids, all_ends = np.concatenate((self.known_ids, ids)), np.concatenate((self.known_ends, ends + len(self.known_ids)))
        start = np.concatenate(([0], all_ends[:-1])) if len(all_ends) else all_ends
        first, many = start[at], (all_ends - start)[at]
        if len(all_ends) <= self.MOST:
            self.known, self.known_ids, self.known_ends = pa.concat_arrays([self.known, missing]), all_ids, all_ends
        elif len(parts) <= self.MOST:  # what this batch used stays
            self.known, self.known_ids, self.known_ends = pa.concat_arrays([parts]), all_ids[_ragged(first, many)], np.cumsum(many)
        else:
            self._forget()
        return all_ids, first, many

    def _pieces(self, pieces: pa.Array, others: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and start and number of them, of distinct pieces with a blank before each, and of other texts as they are.

        No piece is empty, holds a blank, or has white space at an end."""
        plain = pc.and_(pc.string_is_ascii(pieces), pc.ascii_is_alpha(pieces)).to_numpy(zero_copy_only=False)
        nothing, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        alone = pc.binary_join_element_wise(nothing, pieces.filter(pa.array(plain)), blank)  # one pre-token each
        mixed = pieces.filter(pa.array(~plain)).to_pylist()
        parts = self.parts(" " + " ".join(mixed)) if mixed else []
        begins = np.flatnonzero(np.fromiter((p[0] == " " for p in parts), bool, len(parts)))
        lists = [self.parts(o) for o in others]
        more = np.array([len(x) for x in lists], np.int64)
        # numbers of the distinct pre-tokens of each piece
        coded = pa.concat_arrays([alone, pa.array(chain(parts, *lists), pa.large_string())]).dictionary_encode()
        named = coded.indices.to_numpy()
        ids, start, many = self._pretokens(coded.dictionary)
        n = np.ones(len(pieces) + len(others), np.int64)
        n[: len(pieces)][~plain] = np.diff(np.append(begins, len(parts)))
        n[len(pieces) :] = more
        at = np.zeros(len(n), np.int64)
        at[: len(pieces)][plain] = np.arange(len(alone))
        rest = np.flatnonzero(np.concatenate((~plain, np.ones(len(others), bool))))
        at[rest] = len(alone) + np.cumsum(n[rest]) - n[rest]
        every = named[_ragged(at, n)]
        sizes = np.concatenate(([0], np.cumsum(many[every])))
        ends = np.cumsum(n)
        return ids[_ragged(start[every], many[every])], sizes[ends - n], sizes[ends] - sizes[ends - n]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; null is an empty text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.fill_null("") if texts.null_count else texts
        if not len(texts) or not self.cuts:
            return self._library(texts.to_pylist())
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        place, pieces = coded.indices.to_numpy(), coded.dictionary
        # white space at an end of a piece, or none between two blanks: the text is cut by the pattern
        offsets, data = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1), np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        some = offsets[1:] > offsets[:-1]
        maybe = ~some
        low, high = data[offsets[:-1][some]], data[offsets[1:][some] - 1]
        maybe[some] = (low < 33) | (low >= 0x80) | (high < 33) | (high >= 0x80)
        check = np.flatnonzero(maybe)
        odd = np.zeros(len(pieces), bool)
        odd[check] = [not p or bool(self.space(p[0]) or self.space(p[-1])) for p in pieces.take(pa.array(check)).to_pylist()]
        by_pattern = np.add.reduceat(odd[place], bounds[:-1]) > 0
        whole = pc.match_substring_regex(texts, self.special.pattern.replace("(?!)", "$^x")).to_numpy(zero_copy_only=False)
        inner = np.repeat(~(by_pattern | whole), np.diff(bounds))
        inner[bounds[:-1]] = False  # the first piece has no blank before it
        used = np.zeros(len(pieces), bool)
        used[place[inner]] = True
        number = np.cumsum(used) - 1
        plain = np.flatnonzero(~by_pattern & ~whole)
        heads = [h or "" for h in pieces.take(pa.array(place[bounds[plain]])).to_pylist()]
        uncut = np.flatnonzero(by_pattern & ~whole)
        ids, start, many = self._pieces(pieces.filter(pa.array(used)), heads + texts.take(pa.array(uncut)).to_pylist())
        first = number[place]
        n = int(used.sum())
        first[bounds[plain]] = n + np.arange(len(plain))
        first[bounds[uncut]] = n + len(plain) + np.arange(len(uncut))
        inner[bounds[plain]] = inner[bounds[uncut]] = True
        every = first[inner]
        sizes = np.concatenate(([0], np.cumsum(many[every])))[np.concatenate(([0], np.cumsum(inner)))[bounds]].tolist()
        flat = memoryview(ids[_ragged(start[every], many[every])].astype("<u4").tobytes())
        out = [bytes(flat[4 * a : 4 * b]) for a, b in zip(sizes, sizes[1:])]
        for i, b in zip(np.flatnonzero(whole).tolist(), self._library(texts.filter(pa.array(whole)).to_pylist()) if whole.any() else ()):
            out[i] = b
        return out


# selector: (ids in a word, bits of each)
LAYOUT = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}


def _bits(v: np.ndarray) -> np.ndarray:
    """The width of the narrowest selector that holds each value, or more than the widest one."""
    widths = np.array(sorted({b for _, b in LAYOUT.values()}), np.uint64)
    return np.append(widths, 61).astype(np.uint8)[np.searchsorted((np.uint64(1) << widths) - np.uint64(1), v)]


_BITS = _bits(np.arange(1 << 17, dtype=np.uint64))


def simple8b_encode(values: np.ndarray) -> np.ndarray:
    """Greedy: each word takes the most values that fit. values: unsigned, up to 64 bits."""
    v = np.ascontiguousarray(values).astype(np.uint64, copy=False)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    bits = _BITS[v] if int(v.max()) < len(_BITS) else _bits(v)
    # what fits a selector fits every larger one, of fewer and wider ids: how many fit gives the densest
    fits = np.zeros(n, np.uint8)
    most, k = bits, 1  # the most bits in the next k values
    for s in sorted(LAYOUT, reverse=True):
        count, width = LAYOUT[s]
        while 2 * k <= count and len(most) > k:
            most, k = np.maximum(most[:-k], most[k:]), 2 * k
        have = n - count + 1
        if have <= 0:
            break
        fit = most[:have] <= width if count == k else np.maximum(most[:have], most[count - k : count - k + have]) <= width
        if not fit.any():
            break
        fits[:have] += fit.view(np.uint8)
    selector = np.where(fits > 0, np.uint8(len(LAYOUT) + 1) - fits, np.uint8(0))
    step = np.array([1] + [LAYOUT[s][0] for s in sorted(LAYOUT)], np.uint8)[selector].tobytes()
    starts, at = [], 0
    put = starts.append
    while at < n:
        put(at)
        at += step[at]
    first = np.array(starts, np.int64)
    chosen = selector[first]
    escaped = chosen == 0
    place = np.arange(len(first)) + np.concatenate(([0], np.cumsum(escaped)[:-1]))
    words = np.zeros(len(first) + int(escaped.sum()), np.uint64)
    words[place[escaped] + 1] = v[first[escaped]]
    for s, (count, width) in LAYOUT.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            word = np.full(len(mine), s << 60, np.uint64)
            for j in range(count):
                word |= v[first[mine] + j] << np.uint64(j * width)
            words[place[mine]] = word
    return words


def simple8b_decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of simple8b_encode."""
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(chosen == 0).tolist():  # an escape's raw word may look like anything; escapes are rare
        if not raw[i]:
            if words[i] or i + 1 >= len(words):
                raise ValueError("damaged block")
            raw[i + 1] = True
    counts = np.array([1] + [LAYOUT[s][0] for s in sorted(LAYOUT)] + [0], np.int64)[chosen]
    counts[raw] = 0
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, width) in LAYOUT.items():
        mine = np.flatnonzero((chosen == s) & ~raw)
        low = np.uint64((1 << width) - 1)
        for j in range(count if len(mine) else 0):
            out[start[mine] + j] = words[mine] >> np.uint64(j * width) & low
    after = np.flatnonzero(raw)
    out[start[after - 1]] = words[after]
    if len(out) != n:
        raise ValueError("damaged block")
    return out


_HEAD = struct.Struct("<4sHHQQQI")


def pack_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    lens = np.array([len(b) // 4 for b in ids], "<u4")
    words = simple8b_encode(np.frombuffer(b"".join(ids), "<u4")).astype("<u8").tobytes()
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return _HEAD.pack(b"PS8B", 1, 0, len(doc_ids), int(lens.sum()), len(words) // 8, zlib.crc32(words)) + docs + nulls + lens.tobytes() + words


def open_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids."""
    magic, version, _, n, total, n_words, crc = _HEAD.unpack_from(block)
    if magic != b"PS8B" or version != 1:
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    docs = np.frombuffer(block, "<i8", n, at)
    nulls = np.frombuffer(block, np.uint8, n, at + 8 * n)
    lens = np.frombuffer(block, "<u4", n, at + 9 * n)
    words = np.frombuffer(block, "<u8", n_words, at + 13 * n)
    if zlib.crc32(words) != crc:
        raise ValueError("damaged block")
    return [None if z else d for d, z in zip(docs.tolist(), nulls.tolist())], lens, simple8b_decode(words, total).astype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, block_ids: int = 1 << 16) -> None:
    """Encode docs (doc_id, text) and write blocks in ascending doc_id order.

    Rows: part (place of the file's range of ids), first (ids of the part before the block), n_ids, block. The task
    that sorted a range encodes it, so nothing but the texts is shuffled; a lost task is run again as a whole."""
    tokenizer = tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)
    kinds = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = TextEncoder.of(tokenizer), TaskContext.get().partitionId()
        names, ids, held, first = [], [], 0, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, first, held, pack_block(names, ids)), kinds.types)], schema=kinds)

        for batch in (s for b in batches for s in slices(b, 4 << 20)):
            for name, b in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                names.append(name)
                ids.append(b + end)
                held += len(b) // 4 + 1
                if held >= block_ids:
                    yield block()
                    first, names, ids, held = first + held, [], [], 0
        if names:
            yield block()

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ordered, encode, "part int, first long, n_ids long, block binary").write.option("compression", "zstd").parquet(path)


def read_token_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids array<int>) from the files, without the texts."""
    small_batches(spark)
    blocks = spark.read.schema("part int, first long, n_ids long, block binary").parquet(path)
    # one row for each file range: as many as the writing job had tasks
    sums = sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    before, rows = 0, []
    for part, n in sums:
        rows.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, before long"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    kinds = pa.schema(fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, lens, ids = open_block(block.as_py())
                ends = np.cumsum(lens.astype(np.int64))
                starts = ends - lens
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(docs, pa.int64()), pa.array(starts + first), pa.array(lens.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=kinds)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.join(offsets, "part").select((F.col("first") + F.col("before")).alias("first"), "block").mapInArrow(decode, schema)


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files of docs and read them back.

    Defined results: a null or empty text is the end id alone; documents without an id come first; repeated ids are
    separate documents, ordered by their text; an empty table gives no rows."""
    path = path or shared_path(docs.sparkSession, "token-ids")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
