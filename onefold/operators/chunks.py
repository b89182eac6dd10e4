"""Chunk numbers, chunk planning, splitting, shuffling and appending of rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.functions import chunk_of
from onefold.operators.rowindex import dense_index
from onefold.session import scratch_path, settle, small_side

CHUNK = "partition_id"


def chunk_count(n: int, rows_per_chunk: int) -> int:
    """Number of chunks for ``n`` rows."""
    return max(1, math.ceil(n / rows_per_chunk))


def chunk_plan(df: DataFrame, rows_per_chunk: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, n, chunks``: a model with more rows gets more chunks, so chunks stay bounded."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(
        "chunks", F.greatest(F.ceil(F.col("n") / F.lit(rows_per_chunk)), F.lit(1)).cast("bigint"))


def chunk_by_plan(df: DataFrame, plan: DataFrame, row_key: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Hash the row key into the planned number of chunks of the row's model."""
    plan = small_side(settle(plan.select(*keys, "chunks")))
    hashed = F.xxhash64(*row_key)
    return df.join(plan, list(keys)).withColumn(CHUNK, chunk_of(hashed, F.col("chunks"))).drop("chunks")


def chunk_by_hash(df: DataFrame, row_key: Sequence[str], k: int) -> DataFrame:
    """Chunk from a hash of a row key.

    The default: it depends on the row alone, so a re-run task gives the same chunks.
    The key should tell rows apart; the chunk fit checks the sizes that come out.
    """
    return df.withColumn(CHUNK, chunk_of(F.xxhash64(*row_key), k))


def chunk_systematic(df: DataFrame, key: str, k: int) -> DataFrame:
    """Integer key modulo k."""
    return df.withColumn(CHUNK, chunk_of(F.col(key), k))


def chunk_by_position(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Row number along the order, modulo k; chunk sizes differ by one row at most."""
    return dense_index(df, order, "__row").withColumn(CHUNK, chunk_of(F.col("__row"), k)).drop("__row")


def chunk_monotonic(df: DataFrame, k: int) -> DataFrame:
    """Running id of Spark modulo k. Use straight after a file scan, where ids are repeatable."""
    return df.withColumn(CHUNK, chunk_of(F.monotonically_increasing_id(), k))


def chunk_random(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Uniform random chunk. Use straight after a file scan, where the draw is repeatable."""
    return df.withColumn(CHUNK, F.floor(F.rand(seed) * k).cast("bigint"))


def split_even(df: DataFrame, order: Sequence[str], n: int, into: str = "slice") -> DataFrame:
    """Slices 1..n of consecutive rows with NTILE sizes, without the one-task NTILE window."""
    rows = dense_index(df, order, "__row")
    total = rows.count()
    small, extra = divmod(total, n)
    head = extra * (small + 1)
    at = F.when(
        F.col("__row") < head, F.floor(F.col("__row") / F.lit(small + 1))
    ).otherwise(F.lit(extra) + F.floor((F.col("__row") - head) / F.lit(max(small, 1))))
    return rows.withColumn(into, (at + 1).cast("int")).drop("__row")


def split_random(df: DataFrame, n: int, seed: int) -> list[DataFrame]:
    """n random slices of about equal size."""
    return df.randomSplit([1.0] * n, seed)


def shuffle_rows(df: DataFrame, seed: int, parts: int | None = None) -> DataFrame:
    """Rows in random order: dealt out over the partitions, then ordered at random inside.

    Dealing is even whatever the rows hold, and Spark repeats it identically for a lost task. The order is drawn
    before the rows move, so it does not hang on the order in which a task receives them.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__u", F.rand(seed)).repartition(parts)
    return dealt.sortWithinPartitions("__u").drop("__u")


def spread_by_chunk(df: DataFrame, k: int) -> DataFrame:
    """Hash repartition on the chunk number; a group-by on it then needs no further shuffle."""
    return df.repartition(k, CHUNK)


def bucketed(df: DataFrame, by: Sequence[str], buckets: int, name: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the rows as a table bucketed and sorted by the columns, and return the table.

    Group-bys and joins on these columns then read bucket by bucket without a shuffle: refits, pieces and scores per
    chunk of the same rows pay for it once. The table lies in ``folder`` (by default below the shared folder) under a
    name of the session's catalog, and stays until it is dropped there. One file per bucket is written: the rows are dealt by the buckets first.
    """
    spark = df.sparkSession
    name = name or f"chunks_{uuid.uuid4().hex[:12]}"
    path = folder or scratch_path(spark, name)
    dealt = df.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def append_slices(*slices: DataFrame) -> DataFrame:
    out = slices[0]
    for part in slices[1:]:
        out = out.unionByName(part)
    return out
