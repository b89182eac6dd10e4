"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``CHUNKS`` chunks of ``CHUNK`` values of 16 bits. Two signatures that differ in at
most ``2 * CHUNKS - 1`` values have, by pigeonhole, a chunk with at most one error; so each chunk is
indexed once with every value left out. All pairs within that distance share a key. At similarity
0.8 a pair lies outside it with probability 2e-5.

No bucket of the index emits all its pairs. First every member is compared with the smallest id of
its buckets; verified links are contracted. Only buckets that still hold several components are
looked at again: their members are compared block by block inside tasks, which emit no more than
the links that join components. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.llm.components import components
from onefold.llm.packs import numbers
from onefold.llm.tokens import mix, shingle_sets, slices
from onefold.session import settle, small_side, stage

CHUNKS = 10
CHUNK = 4
VALUES = CHUNKS * CHUNK
MAX_ERRORS = 2 * CHUNKS - 1
# Members of a bucket that one task compares with each other; larger buckets are cut into pairs of blocks.
BLOCK = 1024

_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_SALT = np.uint64(0x5851F42D4C957F2D)


def signatures(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of the sets that begin at the positions (no set empty)."""
    out = np.empty((len(begin), VALUES), np.uint16)
    for k in range(VALUES):
        least = np.minimum.reduceat(sets * _MULTIPLY[k] + _ADD[k], begin)
        out[:, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature: per chunk and left-out place, a hash of the other values.

    The low 6 bits number the key, so keys of different places never meet.
    """
    chunks = signature.reshape(len(signature), CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(signature), CHUNKS, CHUNK), np.uint64)
    for out_of in range(CHUNK):
        place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(out_of)
        key = np.broadcast_to(place, out.shape[:2])
        for j in range(CHUNK):
            if j != out_of:
                key = mix(key ^ (chunks[:, :, j] + np.uint64(1)) * _SALT)
        out[:, :, out_of] = (key & ~np.uint64(63)) | place
    return out.reshape(len(signature), VALUES)


def _first_shared(equal: np.ndarray) -> np.ndarray:
    """The number of the first key that two signatures share, by their equal places; -1 if none."""
    by_chunk = equal.reshape(*equal.shape[:-1], CHUNKS, CHUNK)
    near = by_chunk.sum(-1) >= CHUNK - 1
    chunk = near.argmax(-1)
    bits = np.take_along_axis(by_chunk, chunk[..., None, None], -2)[..., 0, :]
    key = chunk * CHUNK + np.where(bits.all(-1), 0, (~bits).argmax(-1))
    return np.where(near.any(-1), key, -1)


def _describe(n: int, lower: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, bounds = shingle_sets(part["text"], n, lower)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                begin = bounds[some]
                prints = np.zeros((2, len(size)), np.uint64)
                signature: list = [None] * len(size)
                if len(some):
                    for p, salt in enumerate((np.uint64(0), _SALT)):
                        prints[p, some] = np.add.reduceat(mix(sets ^ salt), begin)
                    for i, row in zip(some, signatures(sets, begin), strict=True):
                        signature[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array(size, pa.int64()), pa.array(prints[0].view(np.int64)),
                    pa.array(prints[1].view(np.int64)), pa.array(signature, pa.binary()),
                ], names=["doc_id", "n_shingles", "print1", "print2", "signature"])
    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            signature = np.stack([numbers(x, np.uint16) for x in batch["signature"]])
            keys = index_keys(signature).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.asarray(batch["id"]), VALUES)), pa.array(keys.ravel()),
            ], names=["id", "key"])


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are within the distance."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.stack([numbers(x, np.uint16) for x in batch[c]]) for c in ("left", "right"))
            near = (left != right).sum(1) <= MAX_ERRORS
            yield batch.select(["a", "b"]).filter(pa.array(near))


def _set_rows(n: int, lower: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, bounds = shingle_sets(part["text"], n, lower)
                each = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(each, pa.binary())], names=["id", "shingles"])
    return run


def linked(shared: int, left: int, right: int, percent: int) -> bool:
    return 100 * shared >= percent * (left + right - shared)


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                x, y = numbers(x, np.uint64), numbers(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(linked(shared, len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The complete groups of a sorted partition, one at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch[c]) for c in by]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        change[0] = last is not None and tuple(k[0] for k in keys) != last
        last = tuple(k[-1] for k in keys)
        table = pa.Table.from_batches([batch])
        begin = 0
        for at in np.flatnonzero(change):
            held.append(table.slice(begin, at - begin))
            yield pa.concat_tables(held)
            held, begin = [], at
        held.append(table.slice(begin))
    if held:
        yield pa.concat_tables(held)


def _open_members(percent: int) -> Callable:
    """Of each block pair: the members with a near signature in another component, at the pair's first key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"]):
            place, label = group["key"][0].as_py() & 63, np.asarray(group["label"])
            if (label == label[0]).all():
                continue
            size, block = np.asarray(group["n_shingles"]), np.asarray(group["block"])
            signature = np.stack([numbers(x, np.uint16) for x in group["signature"].combine_chunks()])
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            active = np.zeros(len(label), bool)
            for lo in range(0, len(label), 64):
                part = slice(lo, lo + 64)
                fit = label[part, None] != label[None, :]
                low = np.minimum(size[part, None], size[None, :])
                fit &= 100 * low >= percent * np.maximum(size[part, None], size[None, :])
                if i != j:
                    fit &= block[part, None] != block[None, :]
                x, y = np.nonzero(fit)
                equal = signature[x + lo] == signature[y]
                near = (equal.sum(1) >= VALUES - MAX_ERRORS) & (_first_shared(equal) == place)
                active[x[near] + lo] = True
                active[y[near]] = True
            yield from group.filter(pa.array(active)).select(["key", "i", "j", "id", "label", "block"]).to_batches()
    return run


def _joining_links(percent: int) -> Callable:
    """Links that join components of a block pair, by set sizes and shared shingles of all its members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"]):
            ids, label, block = (np.asarray(group[c]) for c in ("id", "label", "block"))
            cross = group["i"][0].as_py() != group["j"][0].as_py()
            label = np.unique(label, return_inverse=True)[1]
            sets = [numbers(x, np.uint64) for x in group["shingles"].combine_chunks()]
            size = np.array([len(x) for x in sets])
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            code = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mark = np.zeros(code.max() + 1, np.int32)
            a, b = [], []
            for k in range(len(ids)):
                other = label != label[k]
                if cross:
                    other &= block != block[k]
                if not other.any():
                    continue
                own = code[begin[k]:begin[k] + size[k]]
                mark[own] = 1
                shared = np.add.reduceat(mark[code], begin)
                mark[own] = 0
                hit = np.flatnonzero(other & (100 * shared >= percent * (size + size[k] - shared)))
                for h in hit:
                    if label[h] != label[k]:
                        a.append(ids[k])
                        b.append(ids[h])
                        label[label == label[h]] = label[k]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """Components of documents whose sets of ``words``-word shingles have a similarity of ``percent`` %.

    Result per input row: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id
    (smallest doc_id reachable over links), kept (doc_id = component_id).

    Words are those of ``tokens``; with fewer than ``words`` of them the whole sequence is the one
    shingle. A null or blank text has no shingle and links with nothing. Rows with one doc_id are
    one document, linked whatever their texts. A row without doc_id takes no part: its component is
    null and it is kept. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(texts.mapInArrow(
        _describe(words, lower), "doc_id long, n_shingles long, print1 long, print2 long, signature binary"
    ), "signatures")
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "print1", "print2"]
    classes = settle(some.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")))

    index = classes.select("id", "signature").mapInArrow(_index, "id long, key long")
    shared = index.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot < top").drop("top")
    members = stage(index.join(shared, "key"), "members")

    signed = classes.select("id", "signature", "n_shingles")
    pairs = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    side = {c: signed.select(F.col("id").alias(c), F.col("signature").alias(s), F.col("n_shingles").alias(f"n_{c}"))
            for c, s in (("a", "left"), ("b", "right"))}
    pairs = pairs.join(side["a"], "a").join(side["b"], "b")
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    pairs = settle(pairs.select("a", "b", "left", "right").mapInArrow(_near_pairs, "a long, b long"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """Shingle sets of these ids, from their texts."""
        wanted = small_side(settle(ids.select("id").distinct()))
        text = texts.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi").distinct()
        return text.mapInArrow(_set_rows(words, lower), "id long, shingles binary")

    sets = sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
    sets = stage(sets, "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    links = settle(both.mapInArrow(_confirm(percent), "a long, b long"))
    found = stage(rows.join(classes.select(*same, F.col("id").alias("class_id")), same, "left"), "found")
    one_id = found.where("class_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("class_id").alias("a"), F.max("class_id").alias("b")
    ).where("a < b").select("a", "b")
    labels = settle(components(links.unionByName(one_id)))

    label = F.coalesce("root", "id").alias("label")
    named = members.select("key", "id").join(labels, "id", "left").select("key", "id", label)
    unsettled = named.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")
    ).where("low < high").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    cut = named.join(unsettled, "key").join(signed, "id")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "id", "label", "block", "n_shingles", "signature")
    order = ["key", "i", "j"]
    active = cut.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        _open_members(percent), "key long, i int, j int, id long, label long, block int"
    )
    active = stage(active, "active")
    late = active.join(sets_of(active), "id").repartition(*order).sortWithinPartitions(*order)
    more = settle(late.mapInArrow(_joining_links(percent), "a long, b long"))

    roots = components(labels.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    found = found.join(roots.withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "class_id", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", "class_id", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
