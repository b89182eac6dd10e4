"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers and dealt to blocks. For a block the index holds, per dimension,
bitmaps of the bits of its values above the block's minimum. A query adds the slices of all
dimensions, weighted by its own integers, with full adders on whole bitmaps (two's complement is
avoided by complementing slices where the weight is negative), walks the sum from its most
significant slice down to find the k-th value, and resolves the rows near that boundary exactly.
The lowest ``DROPPED_BITS`` slices are left out of the sum; what they can add is bounded, and the
boundary is widened by that bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onefold.llm.packs import numbers
from onefold.session import settle, stage

SCALE = 1024
BLOCK_ROWS = 65_536
# Queries that a copy of a block serves; fewer, down to the second number, where there would be less than TILES tasks.
BLOCK_QUERIES = 4_096
LEAST_QUERIES = 256
TILES = 64
DROPPED_BITS = 3
# Rows with a component from here on (after scaling) have blocks of their own and are scored with exact integers.
WIDE = 1 << 27
# Beyond this a component does not fit 64 bits.
MAX_COMPONENT = 1 << 61
_LONG = (1 << 63) - 1


class BitSlices:
    """Bitmaps of the bits of a block of integer vectors (rows x dimensions)."""

    def __init__(self, vectors: np.ndarray, dropped: int = DROPPED_BITS):
        self.rows, self.dims = vectors.shape
        self.dropped = dropped
        self.low = vectors.min(0) if self.rows else np.zeros(self.dims, np.int64)
        self.words = -(-self.rows // 64)
        above = (vectors - self.low).T
        self.width = [max(0, int(x).bit_length() - dropped) for x in above.max(1)] if self.rows else [0] * self.dims
        self.slices = [
            [self._bitmap(((above[d] >> (b + dropped)) & 1).astype(bool)) for b in range(self.width[d])] for d in range(self.dims)
        ]
        self.all = self._bitmap(np.ones(self.rows, bool))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        out[:len(packed)] = packed
        return out.view(np.uint64)

    def to_bytes(self) -> bytes:
        return np.concatenate([s for d in self.slices for s in d] or [np.zeros(0, np.uint64)]).tobytes()

    @classmethod
    def from_bytes(cls, rows: int, low: np.ndarray, width: np.ndarray, data: bytes, dropped: int) -> BitSlices:
        self = cls.__new__(cls)
        self.rows, self.dims, self.dropped, self.low, self.width = rows, len(low), dropped, low, width.tolist()
        self.words = -(-rows // 64)
        each = iter(np.frombuffer(data, np.uint64).reshape(-1, self.words) if self.words else [])
        self.slices = [[next(each) for _ in range(w)] for w in self.width]
        self.all = self._bitmap(np.ones(rows, bool))
        return self

    def weighted_sum(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum of |weight| times value (or its complement for a weight below 0)."""
        columns: list[list[np.ndarray]] = []
        for d in range(self.dims):
            weight = int(query[d])
            for b, own in enumerate(self.slices[d]):
                bits = own if weight > 0 else self.all ^ own
                left, place = abs(weight), b
                while left:
                    if left & 1:
                        while len(columns) <= place:
                            columns.append([])
                        columns[place].append(bits)
                    left >>= 1
                    place += 1
        out, place = [], 0
        while place < len(columns):
            held = columns[place]
            while len(held) > 1:
                a, b = held.pop(), held.pop()
                c = held.pop() if len(held) else None
                half = a ^ b
                carry = a & b
                if c is not None:
                    carry |= half & c
                    half ^= c
                held.insert(0, half)
                if place + 1 == len(columns):
                    columns.append([])
                columns[place + 1].append(carry)
            out.append(held[0] if held else np.zeros(self.words, np.uint64))
            place += 1
        return out

    def near_top(self, query: np.ndarray, k: int, without: np.ndarray) -> np.ndarray:
        """Row numbers that may be among the k highest inner products; ``without`` are left out."""
        total = self.weighted_sum(query)
        open_rows = self.all.copy()
        gone = np.zeros(self.rows, bool)
        gone[without] = True
        allowed = self.all & ~self._bitmap(gone)
        open_rows &= allowed
        sure, need, value = 0, k, 0
        for place in range(len(total) - 1, -1, -1):
            high = open_rows & total[place]
            count = int(np.bitwise_count(high).sum())
            if sure + count >= need:
                open_rows = high
                value |= 1 << place
            else:
                sure += count
                open_rows &= ~total[place]
        # value is the k-th highest sum (or the lowest there is, with fewer rows than k).
        slack = -(-((1 << self.dropped) - 1) * sum(abs(int(x)) for x in query) // (1 << self.dropped))
        least = max(0, value - slack)
        above, equal = np.zeros(self.words, np.uint64), allowed
        for place in range(max(len(total), least.bit_length()) - 1, -1, -1):
            bits = total[place] if place < len(total) else np.zeros(self.words, np.uint64)
            if least >> place & 1:
                equal = equal & bits
            else:
                above |= equal & bits
                equal = equal & ~bits
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), count=self.rows, bitorder="little"))


def top_k(index: BitSlices, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k highest inner products of a block, ties to smaller ids."""
    rows = index.near_top(query, k, np.flatnonzero(ids == own))
    near, asked = vectors[rows].astype(np.int64), query.astype(np.int64)
    most = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (near, asked)]
    if len(query) * most[0] * most[1] <= _LONG:
        scores = near @ asked
    else:
        scores = np.array([min(_LONG, max(-_LONG, sum(a * b for a, b in zip(v, asked.tolist(), strict=True)))) for v in near.tolist()], np.int64)
    best = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows][best], scores[best]


def _packed(vectors: np.ndarray) -> bytes:
    """Vectors in four bytes a component where they fit, else eight."""
    narrow = not vectors.size or max(-int(vectors.min()), int(vectors.max())) < 1 << 31
    return vectors.astype(np.int32 if narrow else np.int64).tobytes()


def _unpacked(data: pa.Scalar, n: int, dims: int) -> np.ndarray:
    raw = numbers(data, np.uint8)
    return raw.view(np.int32 if len(raw) == 4 * n * dims else np.int64).reshape(n, dims)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), dtype=np.int64).reshape(-1, dims)


def _build(dropped: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        dims = rows["dims"][0].as_py()
        vectors = _matrix(rows["vector"], dims)
        index = BitSlices(vectors, dropped)
        return pa.table({
            "dims": rows["dims"].slice(0, 1), "block": rows["block"].slice(0, 1), "n": pa.array([len(vectors)], pa.int32()),
            "ids": pa.array([rows["vec_id"].to_numpy().astype(np.int64).tobytes()]),
            "vectors": pa.array([_packed(vectors)]), "low": pa.array([index.low.astype(np.int64).tobytes()]),
            "width": pa.array([np.array(index.width, np.int32).tobytes()]), "slices": pa.array([index.to_bytes()]),
        })
    return run


def _pack_queries(rows: pa.Table) -> pa.Table:
    dims = rows["dims"][0].as_py()
    return pa.table({
        "dims": rows["dims"].slice(0, 1), "part": rows["part"].slice(0, 1),
        "ids": pa.array([rows["vec_id"].to_numpy().astype(np.int64).tobytes()]),
        "prints": pa.array([rows["print"].to_numpy().astype(np.int64).tobytes()]),
        "vectors": pa.array([_packed(_matrix(rows["vector"], dims))]),
    })


def _search(k: int, dropped: int) -> Callable:
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "print": [], "vec_id": [], "score": []}
        for block in range(blocks.num_rows):
            row = {c: blocks[c][block] for c in blocks.column_names}
            dims, n = row["dims"].as_py(), row["n"].as_py()
            ids = numbers(row["ids"], np.int64)
            vectors = _unpacked(row["vectors"], n, dims)
            index = BitSlices.from_bytes(n, numbers(row["low"], np.int64), numbers(row["width"], np.int32), row["slices"].as_buffer(), dropped)
            for q in range(queries.num_rows):
                owns = numbers(queries["ids"][q], np.int64)
                asked = _unpacked(queries["vectors"][q], len(owns), dims)
                for own, mark, query in zip(owns, numbers(queries["prints"][q], np.int64), asked, strict=True):
                    found, scores = top_k(index, ids, vectors, query, own, k)
                    out["query_id"].append(np.full(len(found), own))
                    out["print"].append(np.full(len(found), mark))
                    out["vec_id"].append(found)
                    out["score"].append(scores)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in out.items()})
    return run


def top_inner_products(
    vectors: DataFrame, is_query, k: int = 10, scale: int = SCALE, block_rows: int = BLOCK_ROWS,
    block_queries: int | None = None, dropped_bits: int = DROPPED_BITS,
) -> DataFrame:
    """For each query row its k highest integer inner products with the other rows: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; a component x becomes floor(scale * x); ``is_query`` is a
    condition on its columns. Ties go to the smaller vec_id. A row never meets rows of its own vec_id.
    Every block of queries is searched in every block of rows; a task holds one of each. Blocks hold up to
    65,536 rows and 4,096 queries, so a row is copied once for 4,096 queries and a query once for each block.

    Rows with a null vec_id, a null or empty vector, or a null or non-finite component take no part, nor
    one that is 2**61 or more after scaling, since no long holds it. Scores are exact; one beyond 64 bits
    is given as the largest or smallest long. Vectors of different lengths are not compared. Repeated rows are candidates of their own; a repeated query is answered
    once. An empty table gives an empty result.
    """
    limit = float(MAX_COMPONENT // scale)
    sound = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL") & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    wide = F.exists("embedding", lambda x: F.abs(x) >= float(WIDE // scale))
    rows = vectors.where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, whole).alias("vector"),
        F.size("embedding").alias("dims"), is_query.alias("asks"), F.when(sound, wide).alias("wide"),
    )
    counts = rows.agg(F.count("*"), F.count_if("asks"), F.count_if("wide")).first()
    plain, extra = max(1, math.ceil(counts[0] / block_rows)), math.ceil(counts[2] / block_rows)
    blocks = plain + extra
    queries = block_queries or min(BLOCK_QUERIES, max(LEAST_QUERIES, -(-counts[1] * blocks // TILES)))
    parts = max(1, math.ceil(counts[1] / queries))
    spread = F.xxhash64("vec_id", "vector")
    block = F.pmod(spread, F.lit(plain))
    if extra:
        block = F.when(F.col("wide"), plain + F.pmod(spread, F.lit(extra))).otherwise(block)
    dealt = rows.withColumn("block", block).drop("wide")
    index = stage(dealt.drop("asks").groupBy("dims", "block").applyInArrow(
        _build(dropped_bits),
        "dims int, block long, n int, ids binary, vectors binary, low binary, width binary, slices binary",
    ), "slices")
    asked = rows.where("asks").withColumn("print", F.xxhash64("vector")).select("vec_id", "print", "vector", "dims").dropDuplicates(["vec_id", "print"])
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "print"), F.lit(parts)))
    asked = settle(asked.groupBy("dims", "part").applyInArrow(_pack_queries, "dims int, part long, ids binary, prints binary, vectors binary"))
    by = ["dims", "block", "part"]
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _search(k, dropped_bits), "query_id long, print long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
