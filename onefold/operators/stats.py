"""Row counts, descriptive statistics and other one-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.functions import standardise


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One typed row per column: ``col, n, mean, sd, min, max``.

    All columns are aggregated in one pass; only the single result row is unpivoted.
    """
    parts = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"sd{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
        ]
    cells = [
        F.struct(
            F.lit(c).alias("col"), F.col(f"n{i}").alias("n"), F.col(f"mean{i}").alias("mean"),
            F.col(f"sd{i}").alias("sd"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*parts).select(F.inline(F.array(*cells)))


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct labels; duplicates are removed before the shuffle."""
    return df.select(column).distinct()


def standardise_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise with the frame's own statistics: one aggregate row, then literals."""
    scales = {r["col"]: (r["mean"], r["sd"]) for r in describe(df, columns).collect()}
    return df.withColumns({c: standardise(F.col(c), *scales[c]) for c in columns})


def centre_in_group(df: DataFrame, group: str, value: str, into: str = "centred") -> DataFrame:
    """Subtract the group mean."""
    return _by_group(df, group, value).withColumn(into, F.col(value) - F.col("__mean")).drop(
        "__mean", "__sd")


def zscore_in_group(df: DataFrame, group: str, value: str, into: str = "zscore") -> DataFrame:
    """(value - group mean) / group sample sd; null for one-row groups, NaN-free for constant ones."""
    sd = F.when(F.col("__sd") > 0, F.col("__sd"))
    return _by_group(df, group, value).withColumn(
        into, (F.col(value) - F.col("__mean")) / sd).drop("__mean", "__sd")


def _by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    # A window would gather a whole group in one task. Aggregating first combines on the map
    # side, and the join back leaves a hot group spread (adaptive execution splits it).
    stats = df.groupBy(F.col(group).alias("__group")).agg(
        F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    return df.join(stats, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Statistics of the union of slices from those of each slice; exact, and nulls for a column without rows."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    n = F.col("n").cast("double")
    # Deviations are taken from the mean of the slices' means, so that large values do not cancel.
    centre = out.groupBy("col").agg(F.avg("mean").alias("__c"))
    moved = out.join(F.broadcast(centre), "col").withColumn("__d", F.col("mean") - F.col("__c"))
    squares = F.coalesce(F.col("sd"), F.lit(0.0)) * F.coalesce(F.col("sd"), F.lit(0.0)) * (n - 1) + n * F.col("__d") * F.col("__d")
    sums = moved.groupBy("col").agg(
        F.sum("n").alias("n"), F.sum(n * F.col("__d")).alias("__s"), F.sum(F.when(n > 0, squares)).alias("__q"),
        F.first("__c").alias("__c"), F.min("min").alias("min"), F.max("max").alias("max"))
    total = F.col("n").cast("double")
    mean = F.when(total > 0, F.col("__s") / total)
    spread = F.when(total > 1, F.sqrt(F.greatest(F.col("__q") - total * mean * mean, F.lit(0.0)) / (total - 1)))
    return sums.select("col", "n", (F.col("__c") + mean).alias("mean"), spread.alias("sd"), "min", "max")


def quantile_sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``col, sketch``: a mergeable quantile sketch per column, in one pass."""
    row = df.agg(*[F.kll_sketch_agg_double(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])))


def merge_quantiles(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("col").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``col, share, value`` from sketches; the rank error is below 2 per cent."""
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    return sketches.select("col", F.inline(F.arrays_zip(wanted.alias("share"), F.kll_sketch_get_quantile_double("sketch", wanted).alias("value"))))
