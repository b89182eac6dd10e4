"""Best-fit packing of token runs into sequences of several permitted lengths.

Documents are dealt by hash to shards of a bounded number of tokens, and every shard is packed by
itself. In a shard pieces come in falling length: each goes to the open bin with the least room
that holds it; if none does, a bin is opened in the permitted length with the least cost per token
it can still be filled with. In the end every bin is downsized to the shortest permitted length
that holds its contents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096)
# Cost of a sequence beside its length, in tokens.
OVERHEAD = 32
SHARD_TOKENS = 2_000_000


def opened(length: int, left: int, lengths: Sequence[int], overhead: int) -> int:
    """The permitted length to open for a piece, ``left`` tokens of shorter pieces still to come."""
    fitting = [c for c in lengths if c >= length]
    return min(fitting, key=lambda c: ((c + overhead) / (length + min(c - length, left)), c))


def pack(sizes: Sequence[int], lengths: Sequence[int], overhead: int) -> tuple[list[int], list[int]]:
    """Bin of each piece (pieces in falling size) and the final capacity of each bin."""
    left = int(sum(sizes))
    rooms: list[int] = []  # the rooms that open bins have, each once
    at_room: dict[int, list[int]] = {}
    bins, used = [], []
    capacity: list[int] = []
    for size in sizes:
        left -= size
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = at_room[room].pop()
            if not at_room[room]:
                del at_room[room]
                rooms.pop(k)
        else:
            b = len(used)
            used.append(0)
            capacity.append(opened(size, left, lengths, overhead))
            room = capacity[b]
        used[b] += size
        bins.append(b)
        room -= size
        if room:
            if room in at_room:
                at_room[room].append(b)
            else:
                at_room[room] = [b]
                insort(rooms, room)
    return bins, [next(c for c in lengths if c >= u) for u in used]


def _pack_shard(lengths: Sequence[int], overhead: int) -> Callable:
    longest = lengths[-1]

    def run(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        rows = rows.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        known = np.asarray(rows["doc_id"].is_valid())
        ids, tokens = rows["doc_id"].fill_null(0).to_numpy(), rows["n_tokens"].to_numpy()
        pieces = -(-tokens // longest)
        owner = np.repeat(np.arange(len(ids)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = number * longest
        size = np.minimum(tokens[owner] - start, longest)
        order = np.lexsort((start, ids[owner], -size))
        bins, capacity = pack(size[order].tolist(), lengths, overhead)
        bins = np.array(bins, np.int64)
        by_bin = np.argsort(bins, kind="stable")
        order, bins = order[by_bin], bins[by_bin]
        bounds = np.searchsorted(bins, np.arange(len(capacity) + 1)).astype(np.int32)
        parts = pa.StructArray.from_arrays(
            [pa.array(ids[owner[order]], pa.int64(), mask=~known[owner[order]]), pa.array(start[order], pa.int64()), pa.array(size[order], pa.int64())],
            names=["doc_id", "start", "length"],
        )
        used = np.add.reduceat(size[order], bounds[:-1])
        return pa.table({
            "shard": pa.array(np.full(len(capacity), shard), pa.int64()),
            "bin": pa.array(np.arange(len(capacity)), pa.int64()), "capacity": pa.array(capacity, pa.int64()),
            "used": pa.array(used, pa.int64()), "pieces": pa.ListArray.from_arrays(pa.array(bounds), parts),
        })
    return run


def pack_documents(
    docs: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, shard_tokens: int = SHARD_TOKENS,
    tokens: str | None = None,
) -> DataFrame:
    """Pack whole documents into sequences; a document longer than the longest length is cut into pieces.

    Result, one row per sequence: shard, bin, capacity (one of ``lengths``), used (tokens), pieces (list
    of doc_id, start, length in tokens, longest first). ``tokens`` names a column of token counts; without
    it a token is a word of the text. Every token of every document is in exactly one piece.

    A null or blank text, or a null or negative count, has no token and is in no sequence. Rows without
    doc_id are packed with doc_id null. Repeated rows are packed as often as they occur. An empty
    table gives no sequence. Other columns are not read.
    """
    lengths = sorted(set(lengths))
    if tokens is None:
        count = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    else:
        count = F.col(tokens).cast("long")
    spread = F.xxhash64("doc_id", *(["text"] if tokens is None else []))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count.alias("n_tokens"), spread.alias("spread")).where("n_tokens > 0")
    # Words are counted once, while packing; four bytes of text per word are enough to number the shards.
    size = docs.agg(F.sum(F.octet_length("text").cast("long") / 4) if tokens is None else F.sum(tokens)).first()[0] or 0
    shards = max(1, math.ceil(size / shard_tokens))
    return counted.withColumn("shard", F.pmod("spread", F.lit(shards))).select("shard", "doc_id", "n_tokens").groupBy("shard").applyInArrow(
        _pack_shard(lengths, overhead),
        "shard long, bin long, capacity long, used long, pieces array<struct<doc_id:long,start:long,length:long>>",
    )
