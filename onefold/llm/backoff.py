"""Stupid-backoff scores of documents by n-gram counts of the whole corpus.

The count tables are partitioned by the hash of the n-gram. A pack of documents explodes its n-grams
once, adds up equal ones and asks the buckets of their hashes; a bucket adds the counts of all packs
and answers in the order of each request; the pack then scores its words and sums per document.
Orders above 2 are asked in rounds of their own, and only for n-grams whose two shorter parts occur
at least twice: one with a part that occurs once occurs once itself, which is its exact count. Where the
counts come from other texts, these tell the buckets all orders in one round and get no answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.llm.packs import bucket_bits, numbers, packed, text_bytes
from onefold.llm.tokens import joined, mix, slices, window_hashes, window_starts, words_of

ORDER = 3
MIN_COUNT = 1
ALPHA = 0.4
# Larger packs add up more equal n-grams before they ask.
PACK_BYTES = 10_000_000
_BYTES_PER_WORD = 6


def small_numbers(values: np.ndarray) -> bytes:
    """Non-negative integers, one byte each where below 255, else 255 and eight bytes at the end."""
    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype(np.uint64).tobytes()


def from_small(data: pa.Scalar, n: int) -> np.ndarray:
    raw = numbers(data, np.uint8)
    out = raw[:n].astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:].tobytes(), np.uint64).astype(np.int64)
    return out


def sorted_hashes(values: np.ndarray) -> bytes:
    """Rising 64-bit values: the first, then six bytes per step; eight bytes each if a step is too long."""
    steps = np.diff(values)
    if len(steps) and int(steps.max()) >> 48:
        return b"8" + values.tobytes()
    return b"6" + values[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_sorted(data: pa.Scalar) -> np.ndarray:
    raw = data.as_py()
    if raw[:1] == b"8":
        return np.frombuffer(raw[1:], np.uint64)
    steps = np.zeros(((len(raw) - 9) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(raw[9:], np.uint8).reshape(-1, 6)
    return np.cumsum(np.concatenate((np.frombuffer(raw[1:9], np.uint64), steps.reshape(-1).view(np.uint64))), dtype=np.uint64)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames, two thirds of what the shuffle's own compression makes of them."""
    tool = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [None if x is None else tool.compress(x.encode()) for x in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["pack"], batch["doc_id"], pa.array(texts, pa.binary())], names=["pack", "doc_id", "text"])


def _texts(rows: pa.Table) -> pa.Table:
    tool = zstandard.ZstdDecompressor()
    return pa.table({"text": pa.array([None if x is None else tool.decompress(x).decode() for x in rows["text"].to_pylist()], pa.string())})


class _Grams:
    """The n-grams of a pack by position, and its distinct ones in rising order of hash."""

    def __init__(self, rows: pa.Table, bits: int, foreign: bool = False):
        self.foreign = foreign
        hashes, counts = [], []
        for batch in _texts(rows).to_batches():
            for part in slices(batch):
                words = words_of(part["text"])
                hashes.append(words.hashes())
                counts.append(words.counts())
        self.bits, self.words = bits, joined(hashes, np.uint64)
        self.first = np.concatenate(([0], np.cumsum(joined(counts, np.int64)))).astype(np.int64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and hash of each n-gram, in text order, and the text of each."""
        at, row = window_starts(self.first, n)
        return at, mix(window_hashes(self.words, n)[at] ^ np.uint64(n)), row

    def cut(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, begin, end) of the runs of rising keys."""
        if not len(keys):
            return
        bucket = keys >> np.uint64(64 - self.bits)
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for a, b in zip(begin, np.append(begin[1:], len(keys)), strict=True):
            yield int(bucket[a]), int(a), int(b)

    def candidates(self, n: int, totals: dict[int, np.ndarray], min_count: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams to ask for, and the mask of the positions they are at."""
        at, hashes, _ = self.of(n)
        if n <= 2 or self.foreign:
            return hashes, np.ones(len(hashes), bool)
        shorter = np.zeros(len(self.words) + 1, np.int64)
        shorter[self.of(n - 1)[0]] = totals[n - 1]
        least = max(min_count, 2)
        likely = (shorter[at] >= least) & (shorter[at + 1] >= least)
        return hashes[likely], likely


def _answers(replies: pa.Table) -> dict[tuple[int, int], pa.Scalar]:
    return {(n.as_py(), b.as_py()): x for n, b, x in zip(replies["n"], replies["bucket"], replies["totals"], strict=True)}


def _known(grams: _Grams, answers: dict, orders: list[int], min_count: int) -> dict[int, np.ndarray]:
    """Corpus counts by position for the orders; 1 where not asked: the count itself, or below ``min_count``."""
    totals: dict[int, np.ndarray] = {}
    for n in orders:
        hashes, asked = grams.candidates(n, totals, min_count)
        keys, of = np.unique(hashes, return_inverse=True)
        count = np.zeros(len(keys), np.int64)
        for bucket, a, b in grams.cut(keys):
            count[a:b] = from_small(answers[n, bucket], b - a)
        totals[n] = np.ones(len(asked), np.int64)
        totals[n][asked] = count[of]
    return totals


def _ask(rows: pa.Table, replies: pa.Table | None, orders: list[int], bits: int, min_count: int, foreign: bool, counted: bool) -> pa.Table:
    out: dict[str, list] = {"bucket": [], "pack": [], "n": [], "hashes": [], "counts": [], "answered": []}
    grams, pack = _Grams(rows, bits, foreign), rows["pack"][0].as_py()
    totals = _known(grams, _answers(replies), list(range(1, orders[0])), min_count) if replies is not None else {}
    for n in orders:
        keys, of = np.unique(grams.candidates(n, totals, min_count)[0], return_inverse=True)
        counts = np.bincount(of, minlength=len(keys)) if counted else np.zeros(len(keys), np.int64)
        for bucket, a, b in grams.cut(keys):
            out["bucket"].append(bucket)
            out["pack"].append(pack)
            out["n"].append(n)
            out["hashes"].append(sorted_hashes(keys[a:b]))
            out["counts"].append(small_numbers(counts[a:b]))
            out["answered"].append(not (foreign and counted))
    return pa.table(out, schema=_REQUEST)


def _answer(requests: pa.Table) -> pa.Table:
    keys = [from_sorted(x) for x in requests["hashes"]]
    counts = joined([from_small(x, len(k)) for x, k in zip(requests["counts"], keys, strict=True)], np.int64)
    every = joined(keys, np.uint64)
    order = np.argsort(every)
    ordered = every[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    total = np.empty(len(order), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], begin), np.diff(np.append(begin, len(order))))
    bounds = np.cumsum([0, *(len(k) for k in keys)])
    wanted = requests["answered"].to_pylist()
    told = [small_numbers(total[a:b]) for a, b, yes in zip(bounds[:-1], bounds[1:], wanted, strict=True) if yes]
    requests = requests.filter(pa.array(wanted, pa.bool_()))
    return pa.table({"pack": requests["pack"], "bucket": requests["bucket"], "n": requests["n"], "totals": pa.array(told, pa.binary())})


def _score(rows: pa.Table, replies: pa.Table, order: int, bits: int, min_count: int, alpha: float, words: int, foreign: bool) -> pa.Table:
    grams = _Grams(rows, bits, foreign)
    totals = _known(grams, _answers(replies), list(range(1, order + 1)), min_count)
    log = np.log(np.maximum(totals[1], 1)) - np.log(max(words, 1))
    shorter = totals[1]
    backed = np.zeros(len(grams.words), np.int64)
    for n in range(2, order + 1):
        at, _, _ = grams.of(n)
        context = np.zeros(len(grams.words) + 1, np.int64)
        context[grams.of(n - 1)[0]] = shorter
        seen = totals[n] >= min_count
        end = at + n - 1
        log[end] = np.where(seen, np.log(np.maximum(totals[n], 1)) - np.log(np.maximum(context[at], 1)), np.log(alpha) + log[end])
        backed[end] = np.where(seen, 0, backed[end] + 1)
        shorter = totals[n]
    row = np.repeat(np.arange(len(grams.first) - 1), np.diff(grams.first))
    count = np.diff(grams.first)
    score = np.bincount(row, weights=log, minlength=len(count))
    return pa.table({
        "doc_id": rows["doc_id"], "n_words": pa.array(count, pa.int64()), "log_score": pa.array(score),
        "per_word": pa.array(score / np.maximum(count, 1), mask=count == 0),
        "n_backed_off": pa.array(np.bincount(row[backed > 0], minlength=len(count)), pa.int64()),
    })


_REQUEST = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("answered", pa.bool_())])


def _word_total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = sum(len(words_of(part["text"]).start) for part in slices(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["words"])


def backoff_scores(
    docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, counts_from: DataFrame | None = None,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, log_score, per_word and n_backed_off.

    A word scores ``c(ngram) / c(context)`` for the longest n-gram up to ``order`` that the corpus holds (at least
    ``min_count`` times), else ``alpha`` times the score one order below; a single word scores its share
    of all words, without a threshold, and one that the corpus does not hold as if it occurred once. log_score is the
    sum of the natural logarithms over the document, per_word its mean, n_backed_off the words that did not match at
    their longest order. The corpus is the texts of ``counts_from``, or ``docs`` itself.

    Words are case-sensitive runs between white space. A null or blank text has log_score 0 and
    per_word null. Repeated rows count in the corpus as often as they occur. Rows without doc_id
    are scored and counted like others. Without any counted word every word scores as one of one. Other columns are not read.
    """
    foreign = counts_from is not None
    text = F.col("text").cast("string").alias("text")
    corpus = (counts_from if foreign else docs).select(text)
    words = corpus.mapInArrow(_word_total, "words long").agg(F.sum("words")).first()[0] or 0
    bits = bucket_bits(words)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    request = "bucket int, pack long, n int, hashes binary, counts binary, answered boolean"
    reply = "pack long, bucket int, n int, totals binary"

    def packs_of(frame: DataFrame) -> DataFrame:
        # Rows without an id are spread by their text.
        own = F.col("doc_id") if "doc_id" in frame.columns else F.lit(None)
        narrow = frame.select(own.cast("long").alias("doc_id"), text)
        dealt = packed(narrow, text_bytes(narrow), PACK_BYTES).select("pack", "doc_id", "text")
        return dealt.mapInArrow(_squeezed, "pack long, doc_id long, text binary")

    packs = packs_of(docs)

    def asked(orders: list[int], replies: DataFrame | None) -> DataFrame:
        run: Callable
        if replies is None:
            run = packs.groupBy("pack").applyInArrow(lambda t: _ask(t, None, orders, bits, min_count, False, True), request)
        else:
            run = packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(
                lambda t, r: _ask(t, r, orders, bits, min_count, False, True), request
            )
        # Dealt out by pack once, for this round's readers and for the scoring.
        return run.groupBy("bucket").applyInArrow(_answer, reply).repartition(parts, "pack")

    if foreign:
        every = list(range(1, order + 1))
        asks = packs.groupBy("pack").applyInArrow(lambda t: _ask(t, None, every, bits, min_count, True, False), request)
        tells = packs_of(counts_from).groupBy("pack").applyInArrow(lambda t: _ask(t, None, every, bits, min_count, True, True), request)
        replies = asks.unionByName(tells).groupBy("bucket").applyInArrow(_answer, reply).repartition(parts, "pack")
    else:
        replies = asked(list(range(1, min(order, 2) + 1)), None)
        for n in range(3, order + 1):
            replies = replies.unionByName(asked([n], replies))
    return packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(
        lambda t, r: _score(t, r, order, bits, min_count, alpha, words, foreign),
        "doc_id long, n_words long, log_score double, per_word double, n_backed_off long",
    )
