"""Generated rows and local rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.functions import bernoulli, chunk_of, logistic

# Share of true coefficients that are 1; the rest are 0.
ACTIVE_SHARE = 0.4


def from_local(spark: SparkSession, pdf: pd.DataFrame, slices: int = 1) -> DataFrame:
    """A pandas frame the user holds on the driver, sent over in slices and appended."""
    cuts = [round(len(pdf) * i / slices) for i in range(slices + 1)]
    parts = [spark.createDataFrame(pdf.iloc[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def add_uniform(df: DataFrame, names: Sequence[str], seed: int, low: float = 0.0) -> DataFrame:
    """Append uniform columns on [low, low + 1)."""
    return df.withColumns({c: F.rand(seed + i) + F.lit(low) for i, c in enumerate(names)})


def generate_groups(spark: SparkSession, n: int, width: int, seed: int) -> DataFrame:
    """``id, y, x1, x2``: n uniform rows in groups of ``width``, made on the executors."""
    ids = spark.range(n).select(F.floor(F.col("id") / F.lit(width)).cast("int").alias("id"))
    return add_uniform(ids, ["y", "x1", "x2"], seed)


def true_betas(p: int, active_share: float = ACTIVE_SHARE) -> list[float]:
    """First share of the coefficients 1, the rest 0."""
    ones = int(p * active_share)
    return [1.0] * ones + [0.0] * (p - ones)


def add_logistic(df: DataFrame, key: Column, p: int, chunks: int, seed: int,
                 active_share: float = ACTIVE_SHARE) -> DataFrame:
    """Append ``partition_id, label, x0 .. x{p-1}`` drawn from a logistic model to given rows."""
    betas = true_betas(p, active_share)
    rows = add_uniform(df, [f"x{j}" for j in range(p)], seed, low=-0.5)
    eta = F.lit(0.0)
    for j, b in enumerate(betas):
        if b:
            eta = eta + F.col(f"x{j}") * F.lit(b)
    return rows.withColumn("label", bernoulli(logistic(eta), seed + p)).withColumn(
        "partition_id", chunk_of(key, chunks))


def simulate_logistic(spark: SparkSession, n: int, p: int, chunks: int, seed: int = 7,
                      active_share: float = ACTIVE_SHARE) -> DataFrame:
    """n simulated rows, generated in parallel; ids modulo ``chunks`` are the chunk numbers."""
    rows = add_logistic(spark.range(n), F.col("id"), p, chunks, seed, active_share)
    return rows.select("partition_id", "label", *[f"x{j}" for j in range(p)])
