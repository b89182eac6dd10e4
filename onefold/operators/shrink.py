"""Adaptive shrinkage of combined estimates: the solution path and its AIC/BIC choice.

The path is computed from one small row per model (estimate and Hessian), so many models
run in parallel as rows of a table and no observation is read again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onefold.operators.newton import unpack
from onefold.spec import INTERCEPT, TermSpec

_EPS = float(np.finfo(float).eps)


def solution_path(hess: np.ndarray, target: np.ndarray, kind: str = "lar", max_steps: int | None = None):
    """Vertices of the least-angle or lasso path of (target - b)' hess (target - b).

    Correlations of active terms fall together; each stretch ends where another term
    catches up, where (lasso) an active one crosses zero, or at the full solution.
    Directly or nearly collinear terms are left at zero for good. It runs to the full solution;
    the level falls at every vertex, so it ends. ``max_steps`` breaks it off before.
    """
    m = len(target)
    max_steps = np.inf if max_steps is None else max_steps
    coef, corr = np.zeros(m), hess @ target
    active: list[int] = []
    barred = {j for j in range(m) if hess[j, j] <= 0.0}
    path, may_add = [coef.copy()], True
    while len(path) <= max_steps:
        free = [j for j in range(m) if j not in active and j not in barred]
        level = max(np.abs(corr[free if free else active]), default=0.0)
        if may_add:
            for j in free:
                if abs(corr[j]) >= level * (1.0 - 1e-12):
                    (active.append if _independent(hess, active, j) else barred.add)(j)
            free = [j for j in free if j not in active and j not in barred]
        if not active or level <= _EPS:
            break
        pull = np.linalg.solve(hess[np.ix_(active, active)], np.sign(corr[active]))
        length = level
        if free:
            slope = hess[np.ix_(free, active)] @ pull
            with np.errstate(divide="ignore", invalid="ignore"):
                meets = np.concatenate([(level - corr[free]) / (1.0 - slope),
                                        (level + corr[free]) / (1.0 + slope)])
            meets = meets[np.isfinite(meets) & (meets > level * 1e-12)]
            length = min(length, meets.min(initial=length))
        leaving: list[int] = []
        if kind == "lasso":
            with np.errstate(divide="ignore", invalid="ignore"):
                zeros = -coef[active] / pull
            ahead = zeros[np.isfinite(zeros) & (zeros > level * 1e-12)]
            if ahead.size and ahead.min() < length:
                length = ahead.min()
                leaving = [j for j, z in zip(active, zeros) if z == length]
        coef[active] += length * pull
        corr = corr - length * (hess[:, active] @ pull)
        coef[leaving] = 0.0
        active = [j for j in active if j not in leaving]
        may_add = not leaving
        path.append(coef.copy())
        if length >= level and not leaving:
            break
    return np.array(path)


def _independent(hess: np.ndarray, active: list[int], j: int) -> bool:
    if not active:
        return True
    cross = hess[active, j]
    rest = hess[j, j] - cross @ np.linalg.solve(hess[np.ix_(active, active)], cross)
    return bool(rest > 1e-12 * hess[j, j])


def shrink(hess: np.ndarray, estimate: np.ndarray, n: float, intercept: bool, kind: str = "lar",
           max_steps: int | None = None):
    """Path on the original scale: ``(betas, rss, dof, aic, bic)``, one entry per step.

    Terms are weighted by their own estimate (adaptive weights). An intercept is profiled
    out, is not shrunk and not counted, and follows from the other terms at each step.
    """
    slopes, h = estimate, hess
    if intercept:
        a11, a12 = hess[0, 0], hess[0, 1:]
        slopes, h = estimate[1:], hess[1:, 1:] - np.outer(a12, a12) / a11
    scale = np.abs(slopes)
    weighted = h * np.outer(scale, scale)
    steps = solution_path(weighted, np.sign(slopes), kind, max_steps)
    gap = np.sign(slopes) - steps
    rss = np.einsum("si,ij,sj->s", gap, weighted, gap)
    betas = steps * scale
    dof = (np.abs(betas) > _EPS).sum(axis=1)
    if intercept:
        head = estimate[0] + (slopes - betas) @ a12 / a11
        betas = np.column_stack([head, betas])
    return betas, rss, dof, rss + 2.0 * dof, rss + np.log(n) * dof


def shrink_path(combined: DataFrame, spec: TermSpec, kind: str = "lar", max_steps: int | None = None) -> DataFrame:
    """One row per model and step: ``keys, step, beta, rss, dof, aic, bic``."""
    if kind not in ("lar", "lasso"):
        raise ValueError("kind is lar or lasso")
    keys, p, intercept = list(spec.keys), spec.p, spec.intercept
    types = {f.name: f.dataType.simpleString() for f in combined.schema.fields}
    names = ["step", "beta", "rss", "dof", "aic", "bic"]
    schema = ", ".join([
        *[f"`{k}` {types[k]}" for k in keys],
        "step int, beta array<double>, rss double, dof int, aic double, bic double"])

    def paths(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                h = unpack(np.asarray(row["hess"], float), p)
                fit = shrink(h, np.asarray(row["wlse"], float), row["n_used"], intercept, kind, max_steps)
                head = [row[k] for k in keys]
                out += [[*head, i, b, r, int(d), a, c] for i, (b, r, d, a, c) in enumerate(zip(*fit))]
            yield pd.DataFrame(out, columns=[*keys, *names])

    usable = combined.filter(F.col("wlse").isNotNull()).select(*keys, "wlse", "hess", "n_used")
    return usable.mapInPandas(paths, schema)


def path_terms(path: DataFrame, spec: TermSpec) -> DataFrame:
    """Long form ``keys, step, term, beta, rss, dof, aic, bic``."""
    terms = F.array(*[F.lit(t) for t in spec.terms])
    return path.select(
        *spec.keys, "step", "rss", "dof", "aic", "bic", F.posexplode("beta").alias("__i", "beta")
    ).withColumn("term", F.element_at(terms, F.col("__i") + 1)).drop("__i")


def choose(path: DataFrame, spec: TermSpec) -> DataFrame:
    """The steps of least AIC and least BIC: ``keys, criterion, step, beta, rss, dof, score``.

    ``min_by`` keeps the best row per model while it aggregates; the earliest step wins a tie.
    """
    picks = []
    for name in ("aic", "bic"):
        best = F.min_by(
            F.struct(F.lit(name).alias("criterion"), "step", "beta", "rss", "dof",
                     F.col(name).alias("score")),
            F.struct(F.col(name), F.col("step")))
        picks.append(best.alias(name))
    one = path.groupBy(*spec.keys).agg(*picks)
    return one.select(*spec.keys, F.inline(F.array("aic", "bic"))).filter(F.col("step").isNotNull())


def rank_steps(path: DataFrame, spec: TermSpec, criterion: str = "bic") -> DataFrame:
    """All steps numbered from best to worst; a path has at most 8p + 1 steps."""
    w = Window.partitionBy(*spec.keys).orderBy(criterion, "step")
    return path.withColumn("place", F.row_number().over(w))


def estimates(combined: DataFrame, path: DataFrame, spec: TermSpec) -> DataFrame:
    """One row per model with all four estimates: ``wlse, one_shot, aic, bic``."""
    best = choose(path, spec)
    wide = best.groupBy(*spec.keys).agg(
        F.first(F.when(F.col("criterion") == "aic", F.col("beta")), ignorenulls=True).alias("aic"),
        F.first(F.when(F.col("criterion") == "bic", F.col("beta")), ignorenulls=True).alias("bic"))
    # One row per model on either side: put them under each other and take what each brings.
    rows = combined.unionByName(wide, allowMissingColumns=True)
    values = [c for c in rows.columns if c not in spec.keys]
    merged = rows.groupBy(*spec.keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])
    return merged.filter(F.col("n_total").isNotNull())


__all__ = ["INTERCEPT", "choose", "estimates", "path_terms", "rank_steps", "shrink", "shrink_path",
           "solution_path"]
