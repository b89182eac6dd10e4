"""Removal of word windows that already start in an earlier document.

Rabin-Karp hashes of every window of ``n`` words are counted in Spark: packs of documents send
their distinct hashes, with the smallest doc_id of each, to buckets of the hash space; a bucket
tells each pack which of its hashes also start in a smaller doc_id elsewhere. The pack then
merges the repeated windows of a document into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.llm.packs import bucket_bits, by_bucket, in_order, numbers, packed, text_bytes
from onefold.llm.tokens import Words, joined, slices, window_hashes, window_starts, words_of

WINDOW = 13
# Bytes of text per word assumed when buckets are numbered; affects their size only.
_BYTES_PER_WORD = 6


def _windows(rows: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of the rows that have a doc_id, in text order."""
    found, owner, begin = [], [], 0
    for batch in rows.select(["text"]).to_batches():
        for part in slices(batch):
            words = words_of(part["text"])
            at, row = window_starts(words.first, n)
            found.append(window_hashes(words.hashes(), n)[at])
            owner.append(row + begin)
            begin += part.num_rows
    hashes, row = joined(found, np.uint64), joined(owner, np.int64)
    known = ~np.asarray(rows["doc_id"].is_null())
    return hashes, np.where(known[row], row, -1) if len(row) else row


class _Keys:
    """The distinct window hashes of a pack in order of first position, cut by bucket."""

    def __init__(self, rows: pa.Table, n: int, bits: int):
        self.hashes, self.row = _windows(rows, n)
        self.judged = self.row >= 0
        ids = np.asarray(rows["doc_id"].fill_null(0), dtype=np.int64)
        self.owner = ids[self.row]
        kept = np.flatnonzero(self.judged)
        _, first, self.key_of = np.unique(self.hashes[kept], return_index=True, return_inverse=True)
        self.kept, self.first = kept, kept[first]
        place = np.argsort(self.first, kind="stable")
        by_position = self.first[place]
        order, self.present, self.bounds = by_bucket(self.hashes[by_position], bits)
        self.sent = place[order]  # keys in the order of the request

    def requests(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, bucket in enumerate(self.present):
            at = self.first[self.sent[self.bounds[i]:self.bounds[i + 1]]]
            yield int(bucket), self.hashes[at], self.owner[at]

    def repeated(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Mask of the windows that start in a document with a smaller doc_id."""
        elsewhere = np.zeros(len(self.first), bool)
        for i, bucket in enumerate(self.present):
            if int(bucket) in answers:
                lo, hi = self.bounds[i], self.bounds[i + 1]
                elsewhere[self.sent[lo:hi]] = np.unpackbits(answers[int(bucket)], count=hi - lo).astype(bool)
        mask = np.zeros(len(self.hashes), bool)
        mask[self.kept] = elsewhere[self.key_of] | (self.owner[self.kept] > self.owner[self.first][self.key_of])
        return mask


def _ask(rows: pa.Table, n: int, bits: int) -> pa.Table:
    out = {"bucket": [], "pack": [], "hashes": [], "ids": [], "runs": []}
    pack = rows["pack"][0].as_py()
    for bucket, hashes, owner in _Keys(in_order(rows), n, bits).requests():
        change = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out["bucket"].append(bucket)
        out["pack"].append(pack)
        out["hashes"].append(hashes.tobytes())
        out["ids"].append(owner[change].tobytes())
        out["runs"].append(np.diff(np.append(change, len(owner))).astype(np.uint32).tobytes())
    return pa.table(out, schema=_REQUEST)


def _answer(requests: pa.Table) -> pa.Table:
    """For each pack: which of its hashes has a smaller doc_id in another request."""
    each = [numbers(x, np.uint64) for x in requests["hashes"]]
    owners = [np.repeat(numbers(i, np.int64), numbers(r, np.uint32)) for i, r in zip(requests["ids"], requests["runs"], strict=True)]
    hashes, owner = joined(each, np.uint64), joined(owners, np.int64)
    order = np.argsort(hashes)
    ordered = hashes[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    owner_ordered = owner[order]
    least = np.repeat(np.minimum.reduceat(owner_ordered, begin), np.diff(np.append(begin, len(ordered))))
    later = np.empty(len(order), bool)
    later[order] = owner_ordered > least
    out, at = {"pack": [], "bucket": [], "later": []}, 0
    for pack, bucket, keys in zip(requests["pack"], requests["bucket"], each, strict=True):
        flags = later[at:at + len(keys)]
        at += len(keys)
        if flags.any():
            out["pack"].append(pack.as_py())
            out["bucket"].append(bucket.as_py())
            out["later"].append(np.packbits(flags).tobytes())
    return pa.table(out, schema=_REPLY)


def _covered(words: Words, begins: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside a window that begins at one of the positions."""
    size = len(words.start) + 1
    step = np.bincount(begins, minlength=size) - np.bincount(begins + n, minlength=size)
    return np.cumsum(step)[:-1] > 0


def _joined_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    kept = np.flatnonzero(keep)
    more = np.zeros(len(kept), bool)
    more[:-1] = text[kept[1:]] == text[kept[:-1]]
    size = len(words.data) + 1
    step = np.bincount(words.start[kept], minlength=size) - np.bincount(words.end[kept], minlength=size)
    mask = np.cumsum(step)[:-1] > 0
    data = words.data.copy()
    gaps = words.end[kept[more]]
    data[gaps] = 0x20
    mask[gaps] = True
    length = np.bincount(text[kept], weights=words.end[kept] - words.start[kept] + more, minlength=len(words.first) - 1)
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[mask]))


def _spans(words: Words, gone: np.ndarray) -> pa.Array:
    """Maximal runs of removed words per text, as [start, end) word positions."""
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    before = np.concatenate(([False], gone[:-1] & (text[1:] == text[:-1]))) if len(gone) else gone
    after = np.concatenate((gone[1:] & (text[1:] == text[:-1]), [False])) if len(gone) else gone
    start, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    owner = text[start]
    pairs = pa.StructArray.from_arrays(
        [pa.array(start - words.first[owner], pa.int32()), pa.array(end + 1 - words.first[owner], pa.int32())],
        names=["start", "end"],
    )
    offsets = np.searchsorted(owner, np.arange(len(words.first))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _remove(rows: pa.Table, answers: pa.Table, n: int, bits: int, untouched: bool) -> pa.Table:
    rows = in_order(rows)
    mask = _Keys(rows, n, bits).repeated(
        {b.as_py(): numbers(x, np.uint8) for b, x in zip(answers["bucket"], answers["later"], strict=True)}
    )
    texts, spans, counts, removed, used = [], [], [], [], 0
    for batch in rows.select(["text"]).to_batches():
        for part in slices(batch):
            words = words_of(part["text"])
            at, _ = window_starts(words.first, n)
            gone = _covered(words, at[mask[used:used + len(at)]], n) if len(words.start) else np.zeros(0, bool)
            used += len(at)
            kept = _joined_words(words, ~gone)
            spans.append(_spans(words, gone))
            counts.append(words.counts())
            removed.append(np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first]))
            texts.append(pc.if_else(pa.array(removed[-1] == 0), part["text"], kept) if untouched else kept)
    return pa.table({
        "doc_id": rows["doc_id"], "rest": rows["rest"],
        "kept_text": pa.chunked_array(texts, pa.string()),
        "removed_spans": pa.chunked_array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        "n_words": pa.array(joined(counts, np.int64), pa.int64()),
        "n_removed": pa.array(joined(removed, np.int64), pa.int64()),
    })


_REQUEST = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary()), ("runs", pa.binary())])
_REPLY = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("later", pa.binary())])


def remove_repeats(docs: DataFrame, window: int = WINDOW, untouched: bool = False) -> DataFrame:
    """Cut every word covered by a window whose words also start in a smaller doc_id.

    ``docs`` needs doc_id and text; other columns, whatever their names, come back in the struct
    ``rest``. Result per input row: doc_id, rest, kept_text (kept words joined by one space),
    removed_spans (maximal [start, end) word intervals), n_words, n_removed. With ``untouched`` a text
    that loses nothing comes back as it is, a null included.

    Windows are judged on the input. A null or blank text gives an empty kept_text. Rows without
    doc_id are kept whole and remove nothing elsewhere. Rows with the same doc_id do not remove
    each other's words. An empty table gives an empty result.
    """
    size = text_bytes(docs)
    bits = bucket_bits(size // _BYTES_PER_WORD)
    packs = packed(docs, size)
    requests = packs.groupBy("pack").applyInArrow(
        lambda rows: _ask(rows, window, bits), "bucket int, pack long, hashes binary, ids binary, runs binary"
    )
    replies = requests.groupBy("bucket").applyInArrow(_answer, "pack long, bucket int, later binary")
    rest = packs.schema["rest"].dataType.simpleString()
    return packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(
        lambda rows, answers: _remove(rows, answers, window, bits, untouched),
        f"doc_id long, rest {rest}, kept_text string, removed_spans array<struct<start:int,end:int>>, n_words long, n_removed long",
    )


def restored(removed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents' own columns, with the kept text and its length in code points."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return removed.select(*[own.get(c, F.col("rest").getField(c)).alias(c) for c in columns])
