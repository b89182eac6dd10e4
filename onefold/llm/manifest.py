"""A Merkle manifest of a table by nested intervals of leaf ranks, and a proof for every row.

Every row is a leaf; leaves of a group in order form a tree of a given fanout, and the groups in
order form the tree above. All leaves have one rank, so each node covers an interval of ranks, and
the intervals of its children lie in it. The tree is cut into bands of levels: a pack is the part of
a band below one node, at most ``PACK_LEAVES`` nodes wide, stored as one row. Going up, a pack gives
one node to the band above. Going down, a pack is joined with the node that contains its interval,
by the bucket of its position (no range join), and takes over that node's path to the root; inside
the pack the siblings of a node are its parent's interval without its own.

Texts are hashed where they are read, so only digests are shuffled. A group of any size is many
packs. What a task holds is one pack, what the driver holds is the number of levels.

Defined cases: nulls are hashed as ``-``; a null group comes first, as does a null order value
inside a group; rows with equal order values are ordered by their digest, and equal rows are
leaves of their own. An empty table has no leaf, no node and no root. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.operators.rowindex import dense_index
from onefold.session import settle, small_side

# Most nodes side by side in a pack.
PACK_LEAVES = 2_187
# Packs are broadcast to their paths below this number; a path is a few kilobytes.
BROADCAST_PATHS = 4_000
_HEX = 64

_NODE = "tree long, pos long, total long, lo long, hi long, digest binary"
_PATH = "tree long, pos long, lefts array<string>, rights array<string>, subroot string, root string"


def field_digest(fields: Sequence[Column]) -> Column:
    """Hex digest of the fields: ``-`` for null, else UTF-8 length, ``:`` and value."""
    parts = [
        F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
        for c in fields
    ]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves``: order value, leaf, subroot, root, proof_sha256, folded_root, verified, group, leaf_rank.

    ``nodes``: group (null and ``of_groups`` for nodes above the subroots), level, covered ranks ``lo`` to
    ``hi`` (exclusive), digest.
    """

    leaves: DataFrame
    nodes: DataFrame


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id",
    fanout: int = 3, tampered: Mapping[str, Column] | None = None, when: Column | None = None, pack_leaves: int = PACK_LEAVES,
) -> Manifest:
    """Leaves with their proofs, and all nodes.

    ``tampered`` replaces fields of the rows where ``when`` holds; their leaves are recomputed and folded with the
    proofs of the untouched table, so ``verified`` tells whether the change is noticed.
    """
    if fanout < 2:
        raise ValueError("a node needs room for two children")
    shape = _Shape(fanout, max(1, int(math.log(max(pack_leaves, fanout), fanout) + 1e-9)))
    plain = {c: F.col(f"`{c}`") for c in fields}
    forged = F.lit(None).cast("string")
    if tampered:
        changed = field_digest([tampered.get(c, plain[c]) for c in fields])
        forged = F.when(F.lit(True) if when is None else when, changed)
    # Read and hashed once: 32 bytes a digest, and no text, from here on.
    leaves = settle(docs.select(
        F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("key"),
        F.unhex(field_digest(list(plain.values()))).alias("digest"), F.unhex(forged).alias("forged")))
    ranked = settle(dense_index(leaves, ["group", "key", "digest"], "rank"))
    groups = dense_index(settle(ranked.groupBy("group").agg(F.min("rank").alias("start"), (F.max("rank") + 1).alias("stop"))), ["group"], "tree")
    groups = settle(groups)
    known = small_side(groups.withColumnRenamed("group", "__group"))
    members = ranked.join(known, F.col("group").eqNullSafe(F.col("__group"))).select(
        "tree", (F.col("rank") - F.col("start")).alias("pos"), (F.col("stop") - F.col("start")).alias("total"),
        F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "key", "forged")

    bands, tops = _grow(members, shape)
    subroots = settle(tops)
    count = subroots.count()
    above = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("total"),
                            "lo", "hi", "digest")
    group_bands, roots = _grow(above, shape)
    root = roots.first()
    root_hex = root["digest"].hex() if root is not None else None

    nothing = F.array().cast("array<string>")
    paths = docs.sparkSession.createDataFrame([] if root is None else [(0, 0, [], [], None, root_hex)], _PATH)
    for packs in reversed(group_bands):
        paths = settle(_descend(packs, paths, shape, top=packs is group_bands[0]))
    # Each group starts from its own path, at the band where its tree ends.
    named = paths.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot", "root")
    sizes = groups.select("tree", _last_band(F.col("stop") - F.col("start"), shape.width, len(bands)).alias("__band"))
    named = settle(named.join(small_side(sizes), "tree"))
    paths = named.limit(0).drop("__band")
    for number in reversed(range(len(bands))):
        inside = paths.unionByName(named.filter(F.col("__band") == number).drop("__band"))
        if number:
            paths = settle(_descend(bands[number], inside, shape))
    key_type = leaves.schema["key"].dataType.simpleString()
    out = _prove(bands[0], inside, shape, key_type) if bands else docs.sparkSession.createDataFrame([], _proof_schema(key_type))
    named_groups = small_side(groups.select(F.col("tree"), "group"))
    out = out.join(named_groups, "tree").select(
        F.col("key").alias(order), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.col("group").alias(group),
        F.col("rank").alias("leaf_rank"))
    spark = docs.sparkSession
    nodes = _listed(spark, bands, shape).join(named_groups, "tree").select("group", F.lit(False).alias("of_groups"), "level", "lo", "hi", "digest")
    nodes = nodes.unionByName(_listed(spark, group_bands, shape).select(
        F.lit(None).cast(leaves.schema["group"].dataType).alias("group"), F.lit(True).alias("of_groups"), "level", "lo", "hi", "digest"))
    return Manifest(out, nodes.withColumnRenamed("group", group))


@dataclass(frozen=True)
class _Shape:
    """Children of a node and levels of a band."""

    fanout: int
    levels: int

    @property
    def width(self) -> int:
        """Nodes below one node of the next band."""
        return self.fanout**self.levels


def _last_band(total: Column, width: int, bands: int) -> Column:
    """Number of the band in which a tree of ``total`` leaves ends."""
    out = F.lit(max(0, bands - 1))
    for number in reversed(range(max(0, bands - 1))):
        out = F.when(total <= width ** (number + 1), number).otherwise(out)
    return out


def _grow(members: DataFrame, shape: _Shape) -> tuple[list[DataFrame], DataFrame]:
    """The packs of every band, and one node per tree: its top.

    ``members`` are the lowest nodes, by tree and position. There are as many rounds as bands, that
    is one for 2,187 leaves, two for 4.8 million and three for 1e10 at a fanout of 3.
    """
    bands, tops = [], members.select(*_names(_NODE)).limit(0)
    nodes = members
    while True:
        extra = [c for c in nodes.columns if c not in _names(_NODE)]
        one = F.struct("pos", "lo", "hi", "digest", *extra)
        packs = settle(nodes.groupBy("tree", F.floor(F.col("pos") / shape.width).cast("long").alias("pack")).agg(
            F.first("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.array_sort(F.collect_list(one)).alias("members")))
        if packs.isEmpty():
            return bands, tops
        bands.append(packs)
        nodes = settle(packs.mapInArrow(_ascend(shape), _NODE))
        tops = tops.unionByName(nodes.filter("total = 1"))
        nodes = nodes.filter("total > 1")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _hexes(members: pa.StructArray) -> bytes:
    """The digests of a pack, end to end, as hex text."""
    return b"".join(members.field("digest").to_pylist()).hex().encode()


def _pyramid(hexes: bytes, total: int, shape: _Shape) -> list[bytes]:
    """Digests of the levels of a pack, from the lowest; ends where the whole tree has one node.

    The last level is the node given to the next band, or the top of the tree.
    """
    rows, step = [hexes], shape.fanout * _HEX
    for _ in range(shape.levels):
        if total == 1:
            break
        below = rows[-1]
        rows.append(b"".join(sha256(below[i:i + step]).hexdigest().encode() for i in range(0, len(below), step)))
        total = -(-total // shape.fanout)
    return rows


def _members(batch: pa.RecordBatch, i: int) -> pa.StructArray:
    return batch.column("members")[i].values


def _ascend(shape: _Shape):
    """The node that each pack gives to the band above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [
                bytes.fromhex(_pyramid(_hexes(_members(batch, i)), total, shape)[-1].decode())
                for i, total in enumerate(batch.column("total").to_pylist())
            ]
            totals = [-(-t // shape.width) for t in batch.column("total").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("pack"), pa.array(totals, pa.int64()), batch.column("lo"), batch.column("hi"),
                 pa.array(tops, pa.binary())], names=_names(_NODE))

    return run


def _with_paths(packs: DataFrame, paths: DataFrame) -> DataFrame:
    """Packs with the path of the node that contains them: equal tree and bucket of the position."""
    found = small_side(paths.withColumnRenamed("pos", "pack"), BROADCAST_PATHS)
    return packs.join(found, ["tree", "pack"])


def _siblings(rows: list[bytes], at: int, fanout: int) -> tuple[list[bytes], list[bytes]]:
    """Per level of the pack: the parent's interval left and right of the node's own."""
    lefts, rights = [], []
    for row in rows[:-1]:
        lo = at - at % fanout
        lefts.append(row[lo * _HEX:at * _HEX])
        rights.append(row[(at + 1) * _HEX:(lo + fanout) * _HEX])
        at //= fanout
    return lefts, rights


def _descend(packs: DataFrame, paths: DataFrame, shape: _Shape, top: bool = False) -> DataFrame:
    """The path to the root of every member of the packs; ``top``: the members are subroots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = _members(batch, i)
                hexes, positions = _hexes(members), members.field("pos").to_pylist()
                rows = _pyramid(hexes, batch.column("total")[i].as_py(), shape)
                tree, end_l, end_r, subroot, root = (batch.column(c)[i].as_py() for c in ("tree", "lefts", "rights", "subroot", "root"))
                out: dict[str, list] = {c: [] for c in _names(_PATH)}
                for at, pos in enumerate(positions):
                    lefts, rights = _siblings(rows, at, shape.fanout)
                    own = hexes[at * _HEX:(at + 1) * _HEX].decode() if top else subroot
                    for name, value in zip(out, (tree, pos, [*(x.decode() for x in lefts), *end_l], [*(x.decode() for x in rights), *end_r], own, root), strict=True):
                        out[name].append(value)
                texts = pa.list_(pa.string())
                types = [pa.int64(), pa.int64(), texts, texts, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return _with_paths(packs, paths).mapInArrow(run, _PATH)


def _proof_schema(key_type: str) -> str:
    return f"tree long, key {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, rank long"


def _prove(packs: DataFrame, paths: DataFrame, shape: _Shape, key_type: str) -> DataFrame:
    """Proof and folded root of every leaf of the packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = _members(batch, i)
                hexes = _hexes(members)
                rows = _pyramid(hexes, batch.column("total")[i].as_py(), shape)
                tree, end_l, end_r, subroot, root = (batch.column(c)[i].as_py() for c in ("tree", "lefts", "rights", "subroot", "root"))
                ends = [(a.encode(), b.encode()) for a, b in zip(end_l, end_r, strict=True)]
                rest = b"".join(a + b for a, b in ends)
                leaf, proof, folded = [], [], []
                for at, forged in enumerate(members.field("forged").to_pylist()):
                    lefts, rights = _siblings(rows, at, shape.fanout)
                    own = hexes[at * _HEX:(at + 1) * _HEX]
                    leaf.append(own.decode())
                    proof.append(sha256(b"".join(a + b for a, b in zip(lefts, rights, strict=True)) + rest).hexdigest())
                    node = own if forged is None else forged.hex().encode()
                    for a, b in (*zip(lefts, rights, strict=True), *ends):
                        node = sha256(a + node + b).hexdigest().encode()
                    folded.append(node.decode())
                n = len(leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * n, pa.int64()), members.field("key"), pa.array(leaf), pa.array([subroot] * n), pa.array([root] * n),
                     pa.array(proof), pa.array(folded), pa.array([x == root for x in folded], pa.bool_()), members.field("lo")],
                    names=["tree", "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "rank"])

    return _with_paths(packs, paths).mapInArrow(run, _proof_schema(key_type))


def _listed(spark: SparkSession, bands: list[DataFrame], shape: _Shape) -> DataFrame:
    """Every node of the bands with its level and the ranks it covers; a band's lowest nodes are the tops of the one below."""
    schema = "tree long, level int, lo long, hi long, digest string"

    def lister(band: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    members = _members(batch, i)
                    lo, hi = members.field("lo").to_pylist(), members.field("hi").to_pylist()
                    rows = _pyramid(_hexes(members), batch.column("total")[i].as_py(), shape)
                    for level, row in enumerate(rows[1:] if band else rows, start=1 if band else 0):
                        step = shape.fanout ** level
                        n = len(row) // _HEX
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch.column("tree")[i].as_py()] * n, pa.int64()), pa.array([band * shape.levels + level] * n, pa.int32()),
                             pa.array(lo[::step], pa.int64()), pa.array([hi[min(len(hi), k + step) - 1] for k in range(0, len(hi), step)], pa.int64()),
                             pa.array([row[k * _HEX:(k + 1) * _HEX].decode() for k in range(n)])],
                            names=["tree", "level", "lo", "hi", "digest"])
        return run

    out = spark.createDataFrame([], schema)
    for band, packs in enumerate(bands):
        out = out.unionByName(packs.mapInArrow(lister(band), schema))
    return out
