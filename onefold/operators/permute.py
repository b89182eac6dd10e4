"""Exact random permutations of row numbers: a bijection computed per row, instead of a sort by a draw.

Row number x is split into (x mod a, x div a) with a * b just above n. Keyed rounds add a hash of one half to
the other, which any number of rounds leaves a bijection of a * b numbers. Results from n on are passed through
again until they fall below n (a handful of rows, rarely twice), so 0..n-1 is permuted exactly. The
result depends on seed, n and the row number alone: not on partitions, order of arrival or lost tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.operators.rowindex import dense_index

ROUNDS = 8
# Passes until a number is below n; the share of rows that need k of them falls as n ** (-k / 2).
_PASSES = 64


def _round(i: int, seed: int, a: int, b: int):
    """Add a keyed hash of one half to the other, in turn."""
    def added(to: Column, of: Column, size: int) -> Column:
        return F.pmod(to + F.pmod(F.xxhash64(of, F.lit(seed), F.lit(i)), F.lit(size)), F.lit(size))

    if i % 2:
        return lambda s: F.struct(s["l"].alias("l"), added(s["r"], s["l"], b).alias("r"))
    return lambda s: F.struct(added(s["l"], s["r"], a).alias("l"), s["r"].alias("r"))


def permuted(x: Column, n: int, seed: int) -> Column:
    """Position of row number ``x`` (0..n-1) in a random permutation of 0..n-1."""
    if n <= 1:
        return x.cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def once(v: Column) -> Column:
        left, right = F.pmod(v, F.lit(a)), F.floor(v / a).cast("long")
        # Each round is a lambda of a one-element array, so that it is computed once and not copied into the next.
        state = F.array(F.struct(left.cast("long").alias("l"), right.alias("r")))
        for i in range(ROUNDS):
            state = F.transform(state, _round(i, seed, a, b))
        return F.element_at(F.transform(state, lambda s: s["r"] * a + s["l"]), 1)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_PASSES)), once(x.cast("long")),
                         lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no position found")).cast("long"))


def random_index(df: DataFrame, order: Sequence[str], seed: int, into: str = "row_id", parts: int | None = None) -> DataFrame:
    """Number the rows 0..n-1 in random order, the same for any partitioning; ``order`` must tell rows apart."""
    numbered = dense_index(df, order, "__at", parts)
    n = numbered.count()
    return numbered.withColumn(into, permuted(F.col("__at"), n, seed)).drop("__at")
