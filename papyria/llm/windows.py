"""64-bit hashes of all windows of k words in a buffer of texts, with numpy.

A buffer is texts of words joined by one blank, each text ended by \\n. A prefix sum of byte codes times powers of an
odd number gives the hash of any byte range; it is then mixed, so equal windows have equal hashes wherever
they stand. Arithmetic is modulo 2 ** 64."""

from __future__ import annotations

import numpy as np
import zstandard

_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE[which], np.uint64), np.full(size, pow(_BASE[which], -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[which]


def mix(h: np.ndarray) -> np.ndarray:
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Buffer:
    """Word places of a buffer: starts, ends (bytes), and first_word, the first word's number of each text."""

    def __init__(self, data: bytes):
        self.data = data
        self.bytes = np.frombuffer(data, np.uint8)
        at = self.bytes
        seps = np.flatnonzero((at == 32) | (at == 10))
        starts = np.concatenate(([0], seps[:-1] + 1)) if len(seps) else seps
        word = seps > starts  # an empty text has no word
        line = at[seps] == 10
        words_upto = np.cumsum(word)
        self.first_word = np.concatenate(([0], words_upto[line])).astype(np.int64)
        self.starts, self.ends = starts[word], seps[word]

    @property
    def texts(self) -> int:
        return len(self.first_word) - 1

    def hashes(self, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
        """Of the byte ranges from word first[i] to word last[i]."""
        up, down = _powers_of(which, len(self.bytes) + 1)
        prefix = np.zeros(len(self.bytes) + 1, np.uint64)
        step = _CODE[which][self.bytes]
        step *= up[: len(self.bytes)]
        np.cumsum(step, out=prefix[1:])
        del step
        a = self.starts[first]
        return mix((prefix[self.ends[last]] - prefix[a]) * down[a])

    def window_starts(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last word of every window of k words inside one text, and the number of windows of each text.

        short: a text of fewer words, but not none, is one window."""
        n = np.diff(self.first_word)
        many = np.maximum(n - k + 1, 0)
        if short:
            many = np.where((n > 0) & (n < k), 1, many)
        before = np.cumsum(many) - many
        first = np.arange(int(many.sum()), dtype=np.int64) + np.repeat(self.first_word[:-1] - before, many)
        return first, first + np.repeat(np.minimum(n, k) - 1, many), many


def pack_ints(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed byte planes of unsigned ints, of their differences if they ascend."""
    v = np.ascontiguousarray(values).astype(np.uint64, copy=False)
    if ascending and len(v):
        v = np.concatenate((v[:1], v[1:] - v[:-1]))
    planes = np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def open_ints(packed: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    v = np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.uint64)
    return np.cumsum(v, dtype=np.uint64) if ascending else v
