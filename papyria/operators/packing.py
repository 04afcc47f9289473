"""Greedy packers over one document's units: where pieces begin and end.

Each decision depends on the one before, so the walk runs in an Arrow-batched UDF on arrays of counts; texts stay in
the JVM. Both walks are linear: the bounds come from prefix sums by bisection."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F

BOUNDS = "array<struct<i:int,j:int>>"


def sentence_bounds(tok: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open ranges of at most target tokens (one sentence at least); each begins at the latest sentence that gives
    at least `overlap` tokens of the range before, and after that range's own start."""
    p, n, out, i = [0, *accumulate(tok)], len(tok), [], 0
    while i < n:
        j = max(i + 1, bisect_right(p, p[i] + target) - 1)
        out.append((i, j))
        if j >= n:
            break
        m = bisect_right(p, p[j] - overlap) - 1
        i = max(i + 1, m)
    return out


def block_bounds(tok: list[int], words: list[int], target: int, carry_words: int) -> list[tuple[int, int]]:
    """Ranges that follow each other; each starts with the estimate of the words carried over from the one before."""
    out, i, carried, n = [], 0, 0, len(tok)
    while i < n:
        running, j = carried * 13 // 10, i
        while j < n and (j == i or running + tok[j] <= target):
            running += tok[j]
            j += 1
        out.append((i, j))
        carried, i = min(carry_words, sum(words[i:j])), j
    return out


def _structs(bounds: list[tuple[int, int]]) -> list[dict]:
    return [{"i": i, "j": j} for i, j in bounds]


def pack_sentences(tok, target: int = 500, overlap: int = 100):
    @F.pandas_udf(BOUNDS)
    def run(counts: pd.Series) -> pd.Series:
        return counts.map(lambda a: _structs(sentence_bounds([int(x) for x in a], target, overlap)))

    return run(tok)


def pack_blocks(tok, words, target: int = 500, carry_words: int = 100):
    @F.pandas_udf(BOUNDS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_structs(block_bounds([int(v) for v in x], [int(v) for v in y], target, carry_words)) for x, y in zip(a, b)])

    return run(tok, words)


