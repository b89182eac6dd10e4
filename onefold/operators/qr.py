"""Least squares by a tree of QR factors, for regressors whose sums of squares would lose them.

Every task reduces its rows of a group to one triangular factor; factors are merged 32 at a time
until one per group is left. The condition number is that of the regressors, not its square. Only triangles of
the size of the model are shuffled, so a group may have any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.session import settle

FAN_IN = 32
# Groups a task holds before it passes their factors on.
_HELD = 512
# Smaller diagonal entries of a factor, relative to their column, mean a regressor the others determine.
_SINGULAR = 1e-13


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The upper factor of the rows, square."""
    q = rows.shape[1]
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, q))
    return np.vstack([r, np.zeros((q - len(r), q))])


def tall_qr(df: DataFrame, columns: Sequence[str], group: str | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """``group, n, r``: the triangular factor of the columns (row by row, ``len(columns)`` squared) of each group.

    Rows with a null in any column are left out.
    """
    names, q = list(columns), len(columns)
    key = F.col(group) if group else F.lit(0)
    rows = df.select(key.alias("__key"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).dropna(
        subset=[f"c{i}" for i in range(q)])
    kind = rows.schema["__key"].dataType.simpleString()
    schema = f"__key {kind}, node bigint, n bigint, r array<double>"

    def reduce_rows(batches):
        node, held = TaskContext.get().partitionId(), {}

        def flush():
            out = pd.DataFrame([[k, node, n, r.ravel()] for k, (n, r) in held.items()], columns=["__key", "node", "n", "r"])
            held.clear()
            return out

        for pdf in batches:
            for k, part in pdf.groupby("__key", dropna=False):
                x = part[[f"c{i}" for i in range(q)]].to_numpy(float)
                n, r = held.get(k, (0, np.zeros((0, q))))
                held[k] = (n + len(x), _triangle(np.vstack([r, x])))
                if len(held) > _HELD:
                    yield flush()
        if held:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _triangle(np.vstack([np.asarray(x, float).reshape(q, q) for x in pdf["r"]]))
        return pd.DataFrame([[pdf["__key"].iloc[0], pdf["node"].iloc[0], int(pdf["n"].sum()), r.ravel()]], columns=["__key", "node", "n", "r"])

    parts = settle(rows.mapInPandas(reduce_rows, schema))
    widest = parts.agg(F.max("node")).first()[0] or 0
    for _ in range(max(1, math.ceil(math.log(widest + 1, fan_in) - 1e-9))):
        parts = parts.withColumn("node", F.floor(F.col("node") / fan_in).cast("bigint"))
        parts = parts.groupBy("__key", "node").applyInPandas(merge, schema)
    return parts.select(*([F.col("__key").alias(group)] if group else []), "n", "r")


def group_ols_qr(df: DataFrame, group: str, y: str, xs: Sequence[str]) -> DataFrame:
    """``group, n, intercept, one slope per regressor, rss``; a regressor that others determine exactly gets 0."""
    q = len(xs) + 2
    factors = tall_qr(df.withColumn("__one", F.lit(1.0)), ["__one", *xs, y], group)
    names = [group, "n", "intercept", *xs, "rss"]
    kind = dict(df.dtypes)[group]
    schema = ", ".join([f"`{group}` {kind}", "n bigint", "intercept double", *[f"`{x}` double" for x in xs], "rss double"])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                r = np.asarray(row["r"], float).reshape(q, q)
                size = np.sqrt((r * r).sum(axis=0))
                good = np.flatnonzero(np.abs(np.diag(r))[:-1] > _SINGULAR * np.maximum(size[:-1], 1e-300))
                b = np.zeros(q - 1)
                small = _triangle(r[:, [*good, q - 1]])
                k = len(good)
                b[good] = np.linalg.solve(small[:k, :k], small[:k, k]) if k else 0.0
                out.append([row[group], row["n"], *b, small[k, k] ** 2])
            yield pd.DataFrame(out, columns=names)

    return factors.mapInPandas(solve, schema)
