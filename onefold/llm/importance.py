"""Importance resampling towards a target set, with exact weights from bit-sliced bucket counts.

Runs of words are hashed into buckets. The bucket counts of the corpus and of the target give every
bucket an integer gain. A document's counts are cut into bit planes, one bit per bucket and plane, and
so are the gains (two's complement, so the last plane counts negative). The sum of count times gain
is then a sum of powers of two times the set bits of the AND of a count plane and a gain plane: only
bitwise operations and popcounts, and exact. Documents are drawn by weight plus Gumbel noise from a
hash of their id, the highest first.

Per task one row per bucket is shuffled for the counts, and one narrow row per document for the ranks;
the driver holds one gain per bucket. Words are hashed twice, since their buckets would be more bytes
than the texts.

Defined cases: null and empty texts have no feature, weight 0, and too few words to be drawn. A null
doc_id is hashed as an empty string and comes after other ids of its score. Rows with one doc_id are
documents of their own; equal scores and ids go by n_features, then weight. Without target texts the
gains follow from T = 0; an empty table gives no row. Other columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.llm.tokens import Words, slices, window_starts, words_of
from onefold.operators.rowindex import dense_index
from onefold.session import settle

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
# Documents whose planes are laid out at once: a byte per document and bucket.
_ROWS = 256
# Longer runs are hashed one by one.
_LONG = 64

# Words are ASCII letters and digits and all characters beyond ASCII.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, all runs a byte at a time."""
    size = end - start
    order = np.argsort(-np.minimum(size, _LONG + 1).astype(np.int8), kind="stable")
    begin, size = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-size, -_LONG, side="left")) if len(size) else 0
    counts = np.bincount(size[long:], minlength=_LONG + 2) if len(size) else np.zeros(_LONG + 2, int)
    active = len(size)
    for i in range(int(size[long]) if long < len(size) else 0):
        active -= int(counts[i])
        part = crc[long:active]
        part[:] = _CRC[(part ^ data[begin[long:active] + i]) & 0xFF] ^ (part >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[start[k]:end[k]].tobytes())
    return out


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each: bytes, starts and ends."""
    size = words.end - words.start + 1
    stop = np.cumsum(size)
    begin = stop - size
    source = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(words.start - begin, size)
    data = words.data[np.minimum(source, max(0, len(words.data) - 1))] if len(source) else words.data[:0]
    data[stop - 1] = 0x20
    return data, begin, stop - 1


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every run of 1 to ``longest`` words, and the words of each text."""
    words = words_of(texts, lower=True, breaks=_OUTSIDE)
    rows, found = [], []
    data, start, end = (words.data, words.start, words.end) if longest == 1 else _spaced(words)
    for n in range(1, longest + 1):
        at, row = window_starts(words.first, n)
        rows.append(row)
        found.append(crc32s(data, start[at], end[at + n - 1]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), words.counts()


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all texts; a task adds up its own before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(features(part.column("text"), longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandfold log ratio of the smoothed bucket shares, rounded down; one integer per bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, corpus), (t, target)):
        for row in bucket_counts(texts, longest, buckets).collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = -(-bits.shape[1] // 64) * 64
    packed = np.zeros((len(bits), wide // 8), np.uint8)
    packed[:, :-(-bits.shape[1] // 8)] = np.packbits(bits, axis=1)
    return packed.view(np.uint64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """Bit planes of the gains in two's complement; the last one is the sign."""
    width = int(max(gain.max(initial=0), -gain.min(initial=0) - 1)).bit_length() + 1
    return _planes(np.array([(gain >> j) & 1 for j in range(width)], bool))


def sliced_sums(row: np.ndarray, bucket: np.ndarray, rows: int, planes: np.ndarray, buckets: int) -> np.ndarray:
    """Sum of the gains of all features of each text, from bit planes of its bucket counts."""
    cells, count = np.unique(row * buckets + bucket, return_counts=True)
    out = np.zeros(rows, np.int64)
    of_row, of_bucket = cells // buckets, cells % buckets
    sign = len(planes) - 1
    for begin in range(0, rows, _ROWS):
        lo, hi = np.searchsorted(of_row, [begin, begin + _ROWS])
        held, where, left = of_row[lo:hi], of_bucket[lo:hi], count[lo:hi]
        k = 0
        while len(left):
            odd = (left & 1).astype(bool)
            some, place = np.unique(held[odd], return_inverse=True)
            if len(some):
                bits = np.zeros((len(some), buckets), bool)
                bits[place, where[odd]] = True
                plane = _planes(bits)
                for j, gain in enumerate(planes):
                    set_bits = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (k + j)
                    out[some] += -set_bits if j == sign else set_bits
            left = left >> 1
            more = left > 0
            held, where, left = held[more], where[more], left[more]
            k += 1
    return out


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the mean gain of the features, rounded down."""
    planes, buckets = gain_planes(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, bucket, n_words = features(part.column("text"), longest, buckets)
                n = np.bincount(row, minlength=part.num_rows)
                total = sliced_sums(row, bucket, part.num_rows, planes, buckets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))],
                    names=["doc_id", "n_words", "n_features", "weight"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def importance_resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, least_words: int = LEAST_WORDS, percent: int = PERCENT,
    seed: int = 2024,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null where it is not drawn."""
    scored = weights(docs, gains(docs, target, longest, buckets), longest)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0))).cast("long")
    scored = settle(scored.withColumn("score", F.col("weight") + noise))
    enough = F.col("n_words") >= least_words
    eligible = scored.where(enough)
    drawn = percent * eligible.count() // 100
    ordered = eligible.withColumns({"__down": -F.col("score"), "__last": F.col("doc_id").isNull()})
    ranked = dense_index(ordered, ["__down", "__last", "doc_id", "n_features", "weight"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
