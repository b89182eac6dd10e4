"""Least squares per group from sums, so groups of any size combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_sums(df: DataFrame, group: str, y: str, xs: Sequence[str]) -> DataFrame:
    """Means and centred second moments per group (numerically stable partial aggregates)."""
    every = [*xs, y]
    means = [F.avg(c).alias(f"mean_{i}") for i, c in enumerate(every)]
    moments = [
        F.covar_samp(F.col(every[i]).cast("double"), F.col(every[j]).cast("double")).alias(f"cov_{i}_{j}")
        for i in range(len(every)) for j in range(i, len(every)) if i < len(xs)
    ]
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *means, *moments)


def group_ols(df: DataFrame, group: str, y: str, xs: Sequence[str]) -> DataFrame:
    """``group, n, intercept, one slope per regressor``; minimum-norm slopes if singular."""
    sums = group_sums(df, group, y, xs)
    q = len(xs)
    names = [group, "n", "intercept", *xs]
    kind = dict(df.dtypes)[group]
    schema = ", ".join([f"`{group}` {kind}", "n bigint", "intercept double",
                        *[f"`{x}` double" for x in xs]])

    def solve(batches):
        for pdf in batches:
            rows = len(pdf)
            s = np.empty((rows, q, q))
            c = np.empty((rows, q))
            for i in range(q):
                for j in range(i, q):
                    s[:, i, j] = s[:, j, i] = pdf[f"cov_{i}_{j}"]
                c[:, i] = pdf[f"cov_{i}_{q}"]
            # Scaled to unit variances, so regressors of different size do not look collinear.
            sd = np.sqrt(np.einsum("rii->ri", s))
            sd = np.where(sd > 0, sd, 1.0)
            r = np.nan_to_num(s / (sd[:, :, None] * sd[:, None, :]))
            slopes = np.einsum("rij,rj->ri", np.linalg.pinv(r, hermitian=True), np.nan_to_num(c / sd)) / sd
            means = pdf[[f"mean_{i}" for i in range(q)]].to_numpy()
            out = pd.DataFrame({group: pdf[group], "n": pdf["n"],
                                "intercept": pdf[f"mean_{q}"] - (means * slopes).sum(axis=1)})
            for i, x in enumerate(xs):
                out[x] = slopes[:, i]
            yield out[names]

    return sums.mapInPandas(solve, schema)
