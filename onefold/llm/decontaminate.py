"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. In a partition whose largest item has ``u``
shingles, an item's sketch is its ``u - ceil(t * u) + 1`` shingles with the smallest hashes (bottom-k
MinHash). A document that contains a share ``t`` of an item misses at most ``u - ceil(t * u)`` of its
shingles, so it must hold a shingle of the sketch: the search loses nothing, however long the
document is. Candidates are verified by counting all shingles of the item in the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.llm.packs import numbers
from onefold.llm.tokens import joined, shingle_sets, slices
from onefold.session import settle

# Items sent to every task; with more of them, item shingles are joined by hash instead.
BROADCAST_SHINGLES = 500_000
# Largest item of each partition, as a power of this ratio.
RATIO = 1.25
_FILTER_BITS = 22


def sketch_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of the sketch of items with these set sizes."""
    upper = np.floor(RATIO ** np.ceil(np.log(np.maximum(sizes, 1)) / np.log(RATIO) - 1e-9)).astype(np.int64)
    upper = np.maximum(upper, sizes)
    return np.minimum(sizes, upper + (-upper * percent) // 100 + 1)


def _item_sets(n: int, lower: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, bounds = shingle_sets(part["text"], n, lower)
                each = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["item_id"], pa.array(np.diff(bounds), pa.int32()), pa.array(each, pa.binary())],
                    names=["item_id", "n_item", "shingles"],
                )
    return run


class _Index:
    """The items' shingles sorted by hash, a bitmap of hash prefixes of the sketches before them."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.percent = np.array(ids, np.int64), percent
        self.size = np.array([len(x) for x in sets], np.int64)
        sketch = sketch_sizes(self.size, percent)
        kept = np.unique(joined([x[:k] for x, k in zip(sets, sketch, strict=True)], np.uint64))
        self.bitmap = np.zeros(1 << _FILTER_BITS, bool)
        self.bitmap[(kept >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        every, owner = joined(sets, np.uint64), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        self.shingle, self.owner, self.sketch = every[order], owner[order], kept

    def search(self, found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, shared shingles) of documents that contain enough of an item."""
        maybe = np.flatnonzero(self.bitmap[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        maybe = maybe[np.isin(found[maybe], self.sketch)]
        docs = np.unique(np.searchsorted(bounds, maybe, side="right") - 1)
        out = []
        for d in docs:
            own = found[bounds[d]:bounds[d + 1]]
            lo, hi = np.searchsorted(self.shingle, own, "left"), np.searchsorted(self.shingle, own, "right")
            hit = np.flatnonzero(hi > lo)
            at = np.concatenate([np.arange(lo[h], hi[h]) for h in hit])
            items, shared = np.unique(self.owner[at], return_counts=True)
            enough = 100 * shared >= self.percent * self.size[items]
            out.append((np.full(enough.sum(), d), items[enough], shared[enough]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(packed: tuple[list[int], list[bytes]], n: int, lower: bool, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(packed[0], [np.frombuffer(x, np.uint64) for x in packed[1]], percent)
        for batch in batches:
            for part in slices(batch):
                doc, item, shared = index.search(*shingle_sets(part["text"], n, lower))
                if len(doc):
                    yield pa.RecordBatch.from_arrays([
                        part["doc_id"].take(pa.array(doc)), pa.array(index.ids[item]),
                        pa.array(index.size[item], pa.int32()), pa.array(shared, pa.int32()),
                    ], names=["doc_id", "item_id", "n_item", "n_shared"])
    return run


def _exploded(n: int, lower: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, bounds = shingle_sets(part["text"], n, lower)
                owner = pa.array(np.repeat(np.arange(part.num_rows), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(owner), part["row"].take(owner), pa.array(sets.view(np.int64))], names=["doc_id", "row", "shingle"]
                )
    return run


def _sketched(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [numbers(x, np.uint64) for x in batch["shingles"]]
            size = np.array([len(x) for x in sets], np.int64)
            sketch = sketch_sizes(size, percent)
            for item, mark, own, k in zip(batch["item_id"], batch["item"], sets, sketch, strict=True):
                yield pa.RecordBatch.from_arrays([
                    pa.array([item.as_py()] * len(own), pa.int64()), pa.array([mark.as_py()] * len(own), pa.int64()), pa.array([len(own)] * len(own), pa.int32()),
                    pa.array(own.view(np.int64)), pa.array(np.arange(len(own)) < k),
                ], names=["item_id", "item", "n_item", "shingle", "sketch"])
    return run


def contained_items(
    docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, lower: bool = True,
    broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds ``percent`` % of the item's ``words``-word shingles.

    Result: doc_id, item_id, n_item and n_shared (shingles), containment; one row per pair.

    An item or document with fewer than ``words`` words has its whole sequence as one shingle; such
    an item is found only as a whole document of the same words. Items without words and null texts
    match nothing. Rows without doc_id or item_id take no part. Repeated rows count once; rows with one
    doc_id and items with one item_id are documents and items of their own, and the best pair of them is
    reported. Other columns are not read.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sets = settle(asked.distinct().mapInArrow(_item_sets(words, lower), "item_id long, n_item int, shingles binary").where("n_item > 0"))
    total = sets.agg(F.sum("n_item").cast("long")).first()[0] or 0
    if total <= broadcast_shingles:
        rows = sets.orderBy("item_id", "shingles").collect()
        packed = ([r["item_id"] for r in rows], [bytes(r["shingles"]) for r in rows])
        pairs = texts.mapInArrow(_search(packed, words, lower, percent), "doc_id long, item_id long, n_item int, n_shared int")
    else:
        # Rows and items with one id stay apart: each is known by its id and a hash of its content.
        marked = sets.withColumn("item", F.xxhash64("shingles")).select("item_id", "item", "shingles")
        parts = marked.mapInArrow(_sketched(percent), "item_id long, item long, n_item int, shingle long, sketch boolean")
        held = texts.withColumn("row", F.xxhash64("text")).mapInArrow(_exploded(words, lower), "doc_id long, row long, shingle long")
        known = settle(held.distinct().join(parts.select("shingle").distinct(), "shingle", "left_semi"))
        likely = known.join(parts.where("sketch"), "shingle").select("doc_id", "row", "item_id", "item", "n_item").distinct()
        pairs = likely.join(known, ["doc_id", "row"]).join(parts.drop("sketch"), ["item_id", "item", "n_item", "shingle"])
        pairs = pairs.groupBy("doc_id", "row", "item_id", "item", "n_item").agg(F.count("*").cast("int").alias("n_shared"))
        pairs = pairs.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")
