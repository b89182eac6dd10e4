"""Level dictionaries: counting, merging, selecting by cumulative share, coding, extending."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onefold.functions import term_name
from onefold.operators.rowindex import running_total
from onefold.session import settle
from onefold.spec import OTHERS

# A factor with more distinct levels than this is ranked by ranges instead of in one window task.
WINDOW_LEVELS = 1_000_000


def level_counts(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``factor, level, n`` for all factors in one pass.

    Rows are unpivoted in place and counted with map-side combining, so what is
    shuffled are distinct levels per task, never rows. Nulls are no level.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in factors
    ])
    cells = df.select(F.inline(pairs)).filter(F.col("level").isNotNull())
    return cells.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Add up the counts of several files or slices."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("factor", "level").agg(F.sum("n").alias("n"))


def rank_levels(counts: DataFrame, window_levels: int = WINDOW_LEVELS, settled: bool = False) -> DataFrame:
    """Append ``rank, cum_n, total, cum_frac`` by falling frequency (ties by level name).

    The counts are used more than once, so they are settled unless they come from a settled frame.
    """
    counts = counts if settled else settle(counts)
    # One row per factor comes back: as many as the model has categorical columns.
    sizes = counts.groupBy("factor").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("levels")).collect()
    order = [F.col("n").desc(), F.col("level").asc()]
    if max((r["levels"] for r in sizes), default=0) <= window_levels:
        w = Window.partitionBy("factor").orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counts.withColumn("cum_n", F.sum("n").over(upto)).withColumn(
            "rank", F.row_number().over(w))
    else:
        ranked = running_total(counts, "factor", order, "n", "cum_n", "rank")
    total = F.lit(None).cast("bigint")
    for r in sizes:
        total = F.when(F.col("factor") == r["factor"], F.lit(r["total"])).otherwise(total)
    return ranked.withColumn("total", total.cast("bigint")).withColumn(
        "cum_frac", F.col("cum_n").cast("double") / F.col("total").cast("double"))


def select_levels(
    counts: DataFrame,
    keep_top: Mapping[str, float],
    min_share: float | None = None,
    window_levels: int = WINDOW_LEVELS,
) -> DataFrame:
    """The level dictionary ``factor, level, n, total, rank, cum_n, cum_frac, kept``.

    A level is kept while the cumulative share is at most ``keep_top`` of its factor.
    With ``min_share`` a level holding at least that share of the rows is kept too.
    """
    ranked = rank_levels(counts, window_levels)
    top = F.lit(None).cast("double")
    for name, share in keep_top.items():
        top = F.when(F.col("factor") == name, F.lit(float(share))).otherwise(top)
    kept = F.col("cum_frac") <= top
    if min_share is not None:
        kept = kept | (F.col("n").cast("double") >= F.lit(float(min_share)) * F.col("total").cast("double"))
    return ranked.withColumn("kept", F.coalesce(kept, F.lit(False)))


def dropped_levels(levels: DataFrame) -> DataFrame:
    """All levels minus the kept ones."""
    return levels.filter(~F.col("kept")).select("factor", "level", "n")


def term_levels(levels: DataFrame, window_levels: int = WINDOW_LEVELS) -> DataFrame:
    """``factor, level, n, code, term`` after collapsing: what the model has terms for.

    ``levels`` is a level dictionary as selected or as read from a store.
    Dropped levels are added up into ``OTHERS`` first; codes follow frequency, 0 first.
    The sum over dropped levels is combined on the map side, however many there are.
    """
    collapsed = levels.groupBy(
        "factor", F.when(F.col("kept"), F.col("level")).otherwise(F.lit(OTHERS)).alias("level")
    ).agg(F.sum("n").alias("n"))
    ranked = rank_levels(collapsed, window_levels, settled=True)
    return ranked.select(
        "factor", "level", "n", (F.col("rank") - 1).cast("int").alias("code"),
        term_name(F.col("factor"), F.col("level")).alias("term"))


def level_slots(terms: DataFrame, window_levels: int = WINDOW_LEVELS) -> DataFrame:
    """``factor, level, slot``: the position of a term level in its factor by name, from 0.

    What ``prepare.add_codes`` takes from a term list, without a list: the levels stay in Spark, however many there are.
    """
    terms = settle(terms.select("factor", "level"))
    # One row per factor comes back.
    sizes = terms.groupBy("factor").agg(F.count(F.lit(1)).alias("levels")).collect()
    if max((r["levels"] for r in sizes), default=0) <= window_levels:
        ranked = terms.withColumn("rank", F.row_number().over(Window.partitionBy("factor").orderBy("level")))
    else:
        ranked = running_total(terms.withColumn("n", F.lit(1)), "factor", [F.col("level").asc()], "n", "cum_n", "rank")
    return ranked.select("factor", "level", (F.col("rank") - 1).cast("int").alias("slot"))


def top_levels(counts: DataFrame, factor: str, k: int) -> DataFrame:
    """The k most frequent levels of one factor (a top-k report)."""
    return (
        counts.filter(F.col("factor") == factor)
        .orderBy(F.col("n").desc(), F.col("level").asc())
        .limit(k)
    )


def extend_levels(terms: DataFrame, factor: str, first: int, last: int) -> DataFrame:
    """Add a factor with the fixed level list ``first .. last``, all kept, in that order."""
    if first > last:
        raise ValueError("empty level range")
    spark = terms.sparkSession
    fixed = spark.range(first, last + 1).select(
        F.lit(factor).alias("factor"),
        F.col("id").cast("string").alias("level"),
        F.lit(None).cast("bigint").alias("n"),
        (F.col("id") - first).cast("int").alias("code"),
        term_name(factor, F.col("id").cast("string")).alias("term"),
    )
    return terms.unionByName(fixed)


def select_levels_from_files(
    spark, paths, schema, factors: Sequence[str], keep_top: Mapping[str, float],
    min_share: float | None = None,
) -> DataFrame:
    """Level dictionary straight from CSV files; only the factor columns are parsed and counted."""
    from onefold.sources.csv import read_csv

    rows = read_csv(spark, paths, schema).select(*factors)
    return select_levels(level_counts(rows, factors), keep_top, min_share)
