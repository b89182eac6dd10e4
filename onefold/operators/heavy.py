"""Level selection for factors with far more levels than are kept: sketch, exact recount, proof.

A mergeable top-k sketch names candidates. One pass counts them exactly and all other rows by hash
bucket of their level, so what is shuffled is bounded by candidates and buckets, not by the levels. A level that is
no candidate cannot be more frequent than its bucket. Only buckets that are heavy enough to hide a kept
level are counted level by level; after that the kept set is proven to be that of a full count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.operators.levels import rank_levels
from onefold.session import settle, small_side
from onefold.spec import OTHERS

CANDIDATES = 4_096
BUCKETS = 1 << 20


def _cells(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in factors])
    return df.select(F.inline(pairs)).filter(F.col("level").isNotNull())


def sketch_levels(df: DataFrame, factors: Sequence[str], candidates: int = CANDIDATES) -> DataFrame:
    """``factor, sketch``: a top-k sketch per factor; sketches of further slices are merged by ``merge_sketches``."""
    return _cells(df, factors).groupBy("factor").agg(F.expr(f"approx_top_k_accumulate(level, {2 * candidates})").alias("sketch"))


def merge_sketches(*parts: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("factor").agg(F.expr(f"approx_top_k_combine(sketch, {2 * candidates})").alias("sketch"))


def select_heavy_levels(
    df: DataFrame, keep_top: Mapping[str, float], min_share: float | None = None, candidates: int = CANDIDATES, buckets: int = BUCKETS,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """The kept levels of the dictionary that ``select_levels`` gives, and per factor one row ``OTHERS`` for all the rest.

    Columns as there: ``factor, level, n, total, rank, cum_n, cum_frac, kept``; the row of the rest has no rank. Use it as levels of a
    model as it is. ``sketches`` are those of the slices, merged; else the rows are sketched here. A share of 1
    keeps every level and so counts every level.
    """
    factors = list(keep_top)
    cells = _cells(df, factors)
    sketches = sketch_levels(df, factors, candidates) if sketches is None else sketches
    named = sketches.select("factor", F.explode(F.expr(f"approx_top_k_estimate(sketch, {candidates})")).alias("c"))
    named = settle(named.select("factor", F.col("c.item").alias("level"), F.lit(True).alias("__known")))
    bucket = F.pmod(F.xxhash64("level"), F.lit(buckets))
    tagged = cells.join(small_side(named), ["factor", "level"], "left")
    known = F.col("__known").isNotNull()
    counted = settle(tagged.groupBy("factor", F.when(known, F.col("level")).alias("level"), F.when(~known, bucket).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")))
    totals = {r["factor"]: r["n"] for r in counted.groupBy("factor").agg(F.sum("n").alias("n")).collect()}

    found = settle(counted.filter("level IS NOT NULL").select("factor", "level", "n"))
    cut = _cuts(_ranked(found, keep_top, min_share, totals), totals, min_share)
    least = F.lit(None).cast("double")
    for name, n in cut.items():
        least = F.when(F.col("factor") == name, F.lit(float(n))).otherwise(least)
    suspects = settle(counted.filter(F.col("bucket").isNotNull() & (F.col("n") >= least)).select("factor", "bucket"))
    if not suspects.isEmpty():
        rest = cells.withColumn("bucket", bucket).join(small_side(suspects), ["factor", "bucket"], "left_semi")
        rest = rest.join(small_side(named), ["factor", "level"], "left_anti").groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"))
        # Levels below the cut come after the first dropped one, whatever is added before it.
        found = settle(found.unionByName(rest.filter(F.col("n") >= least)))
    ranked = settle(_ranked(found, keep_top, min_share, totals))
    kept = ranked.filter("kept")
    sums = kept.groupBy("factor").agg(F.sum("n").alias("n")).collect()
    left = {name: total - sum(r["n"] for r in sums if r["factor"] == name) for name, total in totals.items()}
    rows = [(name, OTHERS, n, totals[name], None, totals[name], 1.0, False) for name, n in left.items() if n]
    others = df.sparkSession.createDataFrame(
        rows, "factor string, level string, n long, total long, rank int, cum_n long, cum_frac double, kept boolean")
    return kept.unionByName(others)


def _ranked(found: DataFrame, keep_top: Mapping[str, float], min_share: float | None, totals: Mapping[str, int]) -> DataFrame:
    """Known levels by falling frequency, with shares of all rows of the factor."""
    total, top = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    for name, n in totals.items():
        total = F.when(F.col("factor") == name, F.lit(n)).otherwise(total)
        top = F.when(F.col("factor") == name, F.lit(float(keep_top[name]))).otherwise(top)
    ranked = rank_levels(found, settled=True).withColumn("total", total.cast("bigint"))
    ranked = ranked.withColumn("cum_frac", F.col("cum_n").cast("double") / F.col("total").cast("double"))
    kept = F.col("cum_frac") <= top
    if min_share is not None:
        kept = kept | (F.col("n").cast("double") >= F.lit(float(min_share)) * F.col("total").cast("double"))
    return ranked.select("factor", "level", "n", "total", "rank", "cum_n", "cum_frac", F.coalesce(kept, F.lit(False)).alias("kept"))


def _cuts(ranked: DataFrame, totals: Mapping[str, int], min_share: float | None) -> dict[str, float]:
    """Per factor the count from which an unknown level could be kept: that of the first level dropped, 0 if none is."""
    first = {r["factor"]: r["n"] for r in ranked.filter("NOT kept").groupBy("factor").agg(F.max("n").alias("n")).collect()}
    cut = {name: float(first.get(name, 0)) for name in totals}
    return cut if min_share is None else {name: min(n, min_share * totals[name]) for name, n in cut.items()}
