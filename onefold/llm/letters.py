"""Letters of whole texts as numpy arrays of code points, for character n-grams and letter words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from onefold.llm.tokens import mix

_BASE = 0xC2B2AE3D27D4EB4F
_table: list[np.ndarray] = []
_powers: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000))
    return _table[0]


def _is_letter(points: np.ndarray) -> np.ndarray:
    out = _letter_table()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        values, at = np.unique(points[high], return_inverse=True)
        out[high] = np.array([chr(int(v)).isalpha() for v in values])[at]
    return out


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts and the text of each.

    Every run of other characters is one space (code 32); each text has a space before and after.
    """
    strings = [(t or "").replace("\x00", " ") for t in texts.to_pylist()]
    points = np.frombuffer(("\x00" + "\x00".join(strings) + "\x00").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.cumsum(points == 0) - 1
    letter = _is_letter(points)
    values = np.where(letter, points, np.uint32(32))
    # Texts meet in one zero: it ends the one before and starts the one after.
    gap = ~letter
    drop = gap & np.concatenate(([False], gap[:-1])) & (points != 0)
    drop |= np.concatenate((gap[:-1] & (points[1:] == 0) & (points[:-1] != 0), [False]))
    keep = ~drop
    return values[keep], np.minimum(text[keep], max(len(strings) - 1, 0))


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """32 well-mixed bits per run of ``n`` code points, by position."""
    count = len(points) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint32)
    out = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        out = (out ^ points[j:j + count]) * np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(15)
    out *= np.uint32(0xC2B2AE35)
    return out ^ (out >> np.uint32(13))


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every maximal run of letters, lower-case."""
    points, text = letters_of(texts)
    letter = points != 32
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
    end = np.flatnonzero(letter & ~np.concatenate((letter[1:], [False]))) + 1
    if not _powers or len(_powers[0]) < len(points):
        size = 1 << (len(points) - 1).bit_length()
        tables = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points.astype(np.uint64) * _powers[0][:len(points)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(np.uint64)), text[start]
