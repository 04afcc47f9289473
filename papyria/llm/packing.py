"""Packing documents into sequences of a fixed capacity by minimum bin slack.

Each task packs its own documents. A document gives its whole windows at once; what remains of it goes to a pool.
Over the pool, kept as a count for each length, a bitset subset-sum program (bit s: some multiset of remaining
lengths sums to s) finds the multiset that, with the largest remaining length, comes closest to the capacity;
backtracking gives its counts, and the pattern is used as often as the counts allow. While a task has more
documents to come, only full windows are written. At its end the pool is finished: slack that no length fits is
filled by cutting a piece, and the last window of under `capacity` ids is cut into powers of two, which need
no padding.

A sequence's number has the task's number above bit 40, so a task that runs again gives the same numbers and no
shuffle is needed. The pool holds at most `pool` pieces.

Defined results: a null or empty text is the end id alone; repeated doc_ids are separate documents; an empty table
gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_arrow, slices
from .tokens import TextEncoder, default_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fullest(counts: dict[int, int], room: int, order: list[int] | None = None) -> dict[int, int]:
    """The multiset of the counted lengths with the largest sum of at most room; longer lengths are tried first.

    order: the lengths, ascending, if they are known; a length of no count may be among them."""
    mask, reach = (1 << room + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []  # reach before, length, copies
    target = 1 << room
    order = sorted(counts) if order is None else order
    for i in range(bisect_right(order, room) - 1, -1, -1):
        length = order[i]
        left, copies = min(counts[length], room // length), 1
        while left and not reach & target:
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach & target:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            used[length] += copies
            at -= length * copies
    return dict(used)


class Packer:
    """Pieces (doc, start, ids as bytes, ids of the document) to rows of SCHEMA."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.pool: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.order: list[int] = []  # lengths in the pool, ascending
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        total, width = len(ids) // 4, self.capacity * 4
        whole = len(ids) // width * width
        for at in range(0, whole, width):
            self._sequence([(doc, at // 4, ids[at : at + width], total)])
        if whole < len(ids):
            self._keep((doc, whole // 4, ids[whole:], total))

    def _keep(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        if length not in self.pool:
            self.pool[length], self.counts[length] = [], 0
            insort(self.order, length)
        self.pool[length].append(piece)
        self.counts[length] += 1
        self.held += 1

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        self.counts[length] -= 1
        self.held -= 1
        if not self.counts[length]:
            del self.pool[length], self.counts[length], self.order[bisect_left(self.order, length)]
        return piece

    def _sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def pack(self, leave: int, last: bool = False) -> None:
        """Write windows until `leave` pieces remain or, unless this is the last call, none can be filled."""
        while self.held > leave:
            largest = self.order[-1]
            self.counts[largest] -= 1
            pattern = fullest(self.counts, self.capacity - largest, self.order)
            self.counts[largest] += 1
            pattern[largest] = pattern.get(largest, 0) + 1
            slack = self.capacity - sum(k * v for k, v in pattern.items())
            if slack and not last:
                return
            times = 1 if slack else min(self.counts[k] // v for k, v in pattern.items())
            for _ in range(times):
                pieces = [self._take(k) for k, v in sorted(pattern.items(), reverse=True) for _ in range(v)]
                if slack and self.held:  # every piece left is longer than the slack
                    doc, start, ids, total = self._take(self.order[-1])
                    pieces.append((doc, start, ids[: 4 * slack], total))
                    self._keep((doc, start + slack, ids[4 * slack :], total))
                elif slack:
                    self._powers(pieces)
                    return
                self._sequence(pieces)

    def _powers(self, pieces: list[tuple]) -> None:
        """The last ids of a task, in sequences whose lengths are powers of two."""
        rest = sum(len(p[2]) // 4 for p in pieces)
        pieces = pieces[::-1]
        while rest:
            room = size = 1 << rest.bit_length() - 1
            out = []
            while room:
                doc, start, ids, total = pieces.pop()
                n = min(room, len(ids) // 4)
                out.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.append((doc, start + n, ids[4 * n :], total))
                room -= n
            self._sequence(out)
            rest -= size


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0, pool: int = 8192) -> DataFrame:
    """One row per piece of a document (doc_id, text); see SCHEMA."""
    tokenizer = tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)
    kinds = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = TextEncoder.of(tokenizer), Packer(capacity, TaskContext.get().partitionId() << 40)

        def rows() -> Iterator[pa.RecordBatch]:
            done, packer.rows = packer.rows, []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], schema=kinds)

        for batch in (s for b in batches for s in slices(b, 4 << 20)):
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                packer.add(doc, ids + end)
                if packer.held >= pool:
                    packer.pack(pool // 8)
                    if packer.held >= pool:  # nothing fills a window now: allow cuts
                        packer.pack(pool // 2, last=True)
            yield from rows()
        packer.pack(0, last=True)
        yield from rows()

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), pack, SCHEMA)
