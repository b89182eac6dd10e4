"""Comparing and reporting coefficient tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.functions import cut_small


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Full outer join of two wide coefficient tables by term name."""
    return a.join(b, [*keys, "term"], "full_outer")


def cut(coef: DataFrame, column: str, threshold: float) -> DataFrame:
    """Coefficients below the threshold become 0."""
    return coef.withColumn(column, cut_small(F.col(column), threshold))


def write_coefficients(coef: DataFrame, path: str) -> None:
    """Coefficient table as CSV with header; p rows, so one file."""
    coef.orderBy("term").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
