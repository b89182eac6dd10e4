"""Words of whole texts as numpy arrays: boundaries, 64-bit hashes, hashes of word windows.

Works on the bytes of an Arrow string column, so a task handles some megabytes of text in a few
vector passes. A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; in UTF-8
these bytes are never part of another character. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text hashed at once; bounds the memory of the 8-byte arrays below.
SLICE_BYTES = 1_500_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        base = _BASES[kind]
        size = 1 << max(12, (n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[kind] = (tables[0], tables[1])
    up, down = _powers[kind]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some texts: ``first[i]:first[i + 1]`` are the words of text ``i``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _power_tables("byte", len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def words_of(texts: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACE) -> Words:
    """Word boundaries of a string array; ``lower`` maps A-Z to a-z first, ``breaks`` marks bytes outside words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
    offsets = offsets - lo
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(texts) + 1, np.int64))
    space = breaks[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], before[0] = space[:-1], True
    after[:-1], after[-1] = space[1:], True
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = True
    after[edges - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return Words(_LOWER[data] if lower else data, start, end, np.searchsorted(start, offsets))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``n`` values, by position; texts are not told apart.

    The polynomial of a window is the difference of two prefix sums, shifted to position 0,
    so every window costs the same few operations whatever ``n`` is.
    """
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables("word", len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:count])


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of ``n`` words of one text starts, and the text of each."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    skipped = first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.arange(counts.sum()) + np.repeat(skipped, counts), row


def run_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run ``begin[i]:end[i]``; runs of other lengths get other hashes."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    up, down = _power_tables("word", len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    length = (end - begin).astype(np.uint64)
    return mix((sums[end] - sums[begin]) * down[begin] + mix(length))


def shingle_sets(texts: pa.Array, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text, end to end, and their bounds.

    A text with 1 to ``n - 1`` words has its whole sequence as its one shingle.
    """
    words = words_of(texts, lower)
    hashes, count = words.hashes(), words.counts()
    at, _ = window_starts(words.first, n)
    windows = window_hashes(hashes, n)[at]
    bounds = np.concatenate(([0], np.cumsum(np.maximum(count - n + 1, 0))))
    short = np.flatnonzero((count > 0) & (count < n))
    whole = dict(zip(short.tolist(), run_hashes(hashes, words.first[short], words.first[short + 1]), strict=True))
    sets = []
    for i in range(len(count)):
        if i in whole:
            sets.append(np.array([whole[i]], np.uint64))
        else:
            x = np.sort(windows[bounds[i]:bounds[i + 1]])
            sets.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x)
    return joined(sets, np.uint64), np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    yield batch.slice(begin)


def joined(parts: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
