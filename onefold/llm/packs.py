"""Packs: bounded groups of documents that ask hash-partitioned tables and get answers back.

A pack is a fixed hash class of doc_id with some megabytes of text. It sends one row per bucket
of the hash space (its distinct keys, aggregated inside the pack), and the bucket answers with a
row for each pack that asked, in the order of the request. A key that occurs in a third of all
documents therefore costs a bucket one entry per pack, and answers need not repeat the keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_BYTES = 3_000_000
# Keys per bucket aimed at; about 16 MB of hashes.
BUCKET_KEYS = 1_500_000


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def packed(docs: DataFrame, size: int, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Columns pack, doc_id, text and rest (the other columns as a struct).

    Rows without doc_id are spread by their text.
    """
    packs = max(1, math.ceil(size / pack_bytes))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    key = F.coalesce(F.xxhash64("doc_id") if "doc_id" in docs.columns else None, F.lit(0))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(key)
    return docs.select(
        F.pmod(key, F.lit(packs)).alias("pack"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"), rest.alias("rest"),
    )


def bucket_bits(keys: int) -> int:
    """Bits of the hash that number the buckets for about ``keys`` keys in all."""
    return max(6, math.ceil(math.log2(max(1, keys / BUCKET_KEYS))))


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a pack in an order that is the same in every pass: by doc_id, then text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by bucket, the buckets present and the bounds of their runs."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    present, begin = np.unique(bucket[order], return_index=True)
    return order, present, np.append(begin, len(order))


def numbers(scalar: pa.Scalar, dtype: type) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), dtype)
