"""Dense row numbers and running totals over a global order, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onefold.session import settle, small_side


def _ranges(df: DataFrame, order: Sequence[Column], parts: int | None) -> DataFrame:
    """Range-partition by the order and fix the partition number as a column.

    Rows are sorted inside a range and get their position there (``__pos``) in the same stage.
    The number of a row must not change between the uses below, so the frame is settled. A last
    key breaks ties, so that equal rows may still be cut apart.
    """
    cut = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, F.col("__tie")]
    ranged = cut.repartitionByRange(parts, *keys) if parts else cut.repartitionByRange(*keys)
    # The id of Spark holds the partition above bit 33 and the position in it below.
    place = ranged.sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    return settle(place.withColumn("__bucket", F.shiftright("__id", 33)).withColumn(
        "__pos", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"))


def dense_index(df: DataFrame, order: Sequence[str], into: str = "row_id", parts: int | None = None) -> DataFrame:
    """0, 1, 2, ... along the order.

    Each range is numbered on its own and shifted by the sizes of the ranges before it.
    """
    cols = [F.col(c) for c in order]
    ranged = _ranges(df, cols, parts)
    sizes = ranged.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # One row per range: as many as there are partitions.
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = small_side(settle(sizes.select(
        "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))))
    return (
        ranged.join(shift, "__bucket")
        .withColumn(into, F.col("__shift") + F.col("__pos"))
        .drop("__bucket", "__tie", "__pos", "__shift")
    )


def running_total(df: DataFrame, group: str, order: Sequence[Column], value: str, into: str, rank: str,
                  parts: int | None = None) -> DataFrame:
    """Running sum of ``value`` and 1-based rank per group, for groups of any size."""
    ranged = _ranges(df, [F.col(group), *order], parts)
    sizes = ranged.groupBy(group, "__bucket").agg(
        F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = small_side(settle(sizes.select(
        group, "__bucket",
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__sum0"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"))))
    inside = Window.partitionBy(group, "__bucket").orderBy(*order, F.col("__tie"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumn(into, F.sum(value).over(upto))
        .withColumn(rank, F.row_number().over(inside))
        .join(shift, [group, "__bucket"])
        .withColumn(into, F.col(into) + F.col("__sum0"))
        .withColumn(rank, (F.col(rank) + F.col("__n0")).cast("int"))
        .drop("__bucket", "__tie", "__pos", "__sum0", "__n0")
    )
