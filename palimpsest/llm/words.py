"""Words, word n-grams and their 64-bit hashes over Arrow batches, with numpy.

A word is a run of bytes other than space and \\x09-\\x0D, which in UTF-8 is
the same as the run of characters. Hashes depend on the bytes alone, so all
workers agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, base & _MASK, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``size`` bytes of ``column``."""
    texts = batch.column(column)
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # else a worker keeps the largest batch it has seen


class Words:
    """The words of a column of texts: flat arrays over all words, with the row of each."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        if lower:
            data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
        self.data, self.rows = data, len(texts)
        inner = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        word = ~_SPACE[data]
        start = word.copy()
        start[1:] &= ~word[:-1]
        start[inner] = word[inner]
        end = word.copy()
        end[:-1] &= ~word[1:]
        last = inner[inner > 0] - 1
        end[last] = word[last]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.offsets)  # word number at which each row begins
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.data)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
            self._hash = mix64((total[self.end] - total[self.start]) * powers(_INVERSE, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))
        return self._hash

    def ngrams(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every window of ``n`` words in a row. short: a row of fewer words gives its whole sequence as one."""
        w = self.hash
        full = max(0, len(w) - n + 1)
        whole = np.zeros(full, np.uint64)
        for k in range(n):
            whole = whole * np.uint64(_BASE) + w[k : k + full]
        same = self.row[:full] == self.row[n - 1 :] if full else np.zeros(0, bool)
        hashes, rows = mix64(whole[same] + np.uint64(n)), self.row[:full][same]
        if short:
            few = np.flatnonzero((self.count > 0) & (self.count < n))
            if len(few):
                own = np.zeros(len(few), np.uint64)
                for k in range(n - 1):
                    have = self.count[few] > k
                    own[have] = own[have] * np.uint64(_BASE) + w[self.first[few[have]] + k]
                own = mix64(own + self.count[few].astype(np.uint64))
                hashes, rows = np.concatenate([hashes, own]), np.concatenate([rows, few])
                order = np.argsort(rows, kind="stable")
                hashes, rows = hashes[order], rows[order]
        return hashes, rows
