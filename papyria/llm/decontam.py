"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Text is lower-cased (A-Z) and read as words, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ . A window is `window` consecutive words of
an item; a shorter item with words is one window of its own. The automaton reads codes of the benchmark's words, all of one
length, so a match gives places of words at once, and those are mapped to code point offsets in the original text.

A benchmark of up to `block_windows` distinct windows is one automaton, and each text is scanned once. A larger one comes to
the driver in blocks of that size; every `held` blocks are one pass over the documents, whose result is written, so that
neither the driver nor a task ever holds more than `held` blocks and a task builds each of its automata once.

Defined results: a null or wordless text has no words and no hits; items without words, or without an id, have no window;
an empty benchmark hits nothing; items that share a window are all counted; repeated item_ids are one item; repeated
documents are separate rows; a very long text is scanned whole, like any other; columns of other names pass through
uncontaminated unchanged. Only doc_id, text and item_id, text are read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, stored

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Bytes of UTF-8 to the normal form: letters lower, other ASCII but digits a blank, the rest unchanged.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:int,end:int>>"

Windows = dict[tuple[bytes, ...], list[str]]
Ranges = list[tuple[int, int]]
Finding = tuple[int, Ranges, list[str]]  # number of words, merged ranges of hit words, items


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def blocks_of(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[Windows]:
    """Windows with the items that hold them, at most block_windows in each block; a long item is cut between blocks."""
    block: dict[tuple[bytes, ...], set[str]] = {}
    for row in benchmark.where("item_id is not null").select("item_id", "text").toLocalIterator():
        words = normal_words(row[1] or "")
        for i in range(max(1, len(words) - window + 1) if words else 0):
            block.setdefault(tuple(words[i : i + window]), set()).add(str(row[0]))
            if len(block) >= block_windows:
                yield {k: sorted(v) for k, v in block.items()}
                block = {}
    if block:
        yield {k: sorted(v) for k, v in block.items()}


class Automaton:
    """Each word of the benchmark is a code of a fixed length, whose letters are of another alphabet at each place: a node of the
    automaton has few branches however many words there are, and a match can't begin or end inside a word."""

    def __init__(self, windows: Windows):
        words = dict.fromkeys(w for window in windows for w in window)
        self.length = 2 if len(words) <= 120**2 else 3
        base = max(2, math.ceil(len(words) ** (1 / self.length)) + 1)
        self.code = {w: "".join(chr(1 + place * base + i // base**place % base) for place in range(self.length)) for i, w in enumerate(words)}
        self.unknown = "\0" * self.length
        self.automaton = ahocorasick.Automaton()
        for window, items in windows.items():
            self.automaton.add_word("".join(map(self.code.__getitem__, window)), (len(window), items))
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Ranges [a, b) of words hit, merged and ascending, and the items."""
        code, unknown, ranges, items = self.code.get, self.unknown, [], set()
        for end, (n, names) in self.automaton.iter("".join([code(w, unknown) for w in words])):
            items.update(names)
            stop = (end + 1) // self.length
            start = stop - n
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append([start, stop])
        return ranges, items


_built: tuple[str, list[Automaton]] = ("", [])


def _automata(sent) -> list[Automaton]:
    """Those of one pass; a worker keeps no other."""
    global _built
    name, blocks = sent.value
    if _built[0] != name:
        _built = ("", [])
        _built = (name, [Automaton(b) for b in blocks])
    return _built[1]


def _merge(ranges: list) -> Ranges:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find(text: str | None, automata: list[Automaton], before: tuple[Ranges, list[str]] = ((), ())) -> Finding:
    words = normal_words(text or "")
    ranges, items = list(before[0]), set(before[1])
    for a in automata if words else ():
        more, names = a.scan(words)
        ranges += more
        items |= names
    return len(words), _merge(ranges), sorted(items)


_SOFAR = "__decontam"


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_windows: int, held: int, finish: Callable[[pa.RecordBatch, list[Finding]], pa.RecordBatch], schema) -> DataFrame:
    """docs through every block of the benchmark; finish makes the result of a batch from what was found in it."""
    source = blocks_of(benchmark, window, block_windows)
    sc, group = docs.sparkSession.sparkContext, list(islice(source, held))

    def step(sent, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (s for b in batches for s in slices(b)):
                at = batch.schema.get_field_index(_SOFAR)
                sofar = [pickle.loads(x) for x in batch.column(at).to_pylist()] if at >= 0 else [((), ())] * batch.num_rows
                found = [find(t, _automata(sent), s) for t, s in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), sofar)]
                plain = batch.drop_columns([_SOFAR]) if at >= 0 else batch
                yield finish(plain, found) if last else plain.append_column(_SOFAR, pa.array([pickle.dumps(f[1:]) for f in found], pa.binary()))

        return run

    d = docs
    while True:
        following = list(islice(source, held))
        sent = sc.broadcast((uuid.uuid4().hex, group))
        if not following:
            return map_arrow(d, step(sent, True), schema)
        d = stored(map_arrow(d, step(sent, False), docs.withColumn(_SOFAR, F.lit(b"")).schema), "decontam-pass")
        sent.destroy()
        group = following


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, block_windows: int = 200_000, held: int = 1) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted), spans (in the original)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def report(batch: pa.RecordBatch, found: list[Finding]) -> pa.RecordBatch:
        rows = []
        for doc, text, (n, ranges, items) in zip(batch.column(0).to_pylist(), batch.column(1), found):
            spans = []
            if ranges:
                at = [m.span() for m in WORD.finditer(text.as_py())]
                spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]
            rows.append((doc, n, sum(b - a for a, b in ranges), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(items) >= min_items, items, spans))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.types)], schema=kinds)

    return _passes(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), benchmark, window, block_windows, held, report, SCHEMA)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_run: int = 8, block_windows: int = 200_000, held: int = 1) -> DataFrame:
    """The rows of docs without a run of min_run words or more that windows of the benchmark cover.

    One window of `window` = min_run words is such a run, so one passage of one item is enough; an item of fewer words, which
    may well occur by chance, is not. All columns pass through the scan, and nothing is shuffled."""

    def keep(batch: pa.RecordBatch, found: list[Finding]) -> pa.RecordBatch:
        return batch.filter(pa.array([all(b - a < min_run for a, b in ranges) for _, ranges, _ in found], pa.bool_()))

    return _passes(docs, benchmark, window, block_windows, held, keep, docs.schema)
