"""Scalar column expressions of logistic regression. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def _num(value: Column | float | int | None) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(None).cast("double") if value is None else F.lit(float(value))


def standardise(x: Column, mean: Column | float, sd: Column | float) -> Column:
    """(x - mean) / sd; 0 where sd is 0, NaN or null, as for a constant column or a single row."""
    spread = _num(sd)
    varies = (spread != 0) & ~F.isnan(spread)
    return F.when(x.isNotNull() & ~F.coalesce(varies, F.lit(False)), F.lit(0.0)).otherwise((x - _num(mean)) / F.nullif(spread, F.lit(0.0)))


def logistic(eta: Column) -> Column:
    """1 / (1 + exp(-eta))."""
    return 1.0 / (1.0 + F.exp(-eta))


def log_density(y: Column, eta: Column) -> Column:
    """y log p + (1 - y) log(1 - p), written so that no log(0) can appear."""
    return y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))


def log_density_from_prob(y: Column, p0: Column, p1: Column) -> Column:
    """The same density from the two class probabilities."""
    return F.when(y == 1, F.log(p1)).otherwise(F.log(p0))


def linear_predictor(columns: Sequence[Column], betas: Sequence[Column | float]) -> Column:
    """Sum of column times coefficient."""
    eta = F.lit(0.0)
    for x, b in zip(columns, betas, strict=True):
        eta = eta + x * _num(b)
    return eta


def dot(xs: Column, betas: Column) -> Column:
    """Linear predictor of two array columns of equal length."""
    return F.aggregate(F.zip_with(xs, betas, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def term_name(factor: Column | str, level: Column) -> Column:
    """``factor_level``."""
    return F.concat_ws("_", F.lit(factor) if isinstance(factor, str) else factor, level)


def chunk_of(key: Column, k: int | Column) -> Column:
    """Non-negative remainder of an integer key."""
    return F.pmod(key, F.lit(k) if isinstance(k, int) else k).cast("bigint")


def group_of(key: Column, width: int) -> Column:
    """Integer group number of a running key."""
    return F.floor(key / F.lit(width)).cast("int")


def cut_small(c: Column, threshold: float) -> Column:
    """0 where |c| is below the threshold."""
    return F.when(F.abs(c) < threshold, F.lit(0.0)).otherwise(c)


def bernoulli(prob: Column, seed: int) -> Column:
    """0/1 draw with the given probability."""
    return (F.rand(seed) < prob).cast("int")


def vector_item(v: Column, i: int) -> Column:
    """Element ``i`` of an ML vector column."""
    return vector_to_array(v).getItem(i)


def has_nan(values: Column) -> Column:
    """True if the array holds a null or NaN."""
    return F.exists(values, lambda v: v.isNull() | F.isnan(v))
