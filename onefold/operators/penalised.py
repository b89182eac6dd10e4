"""Elastic net on combined summaries: coordinate descent on the summed Hessian, with no second pass over rows.

Around the combined estimate the negative log-likelihood is a quadratic in the coefficients, so its penalised
minimum needs only the Hessian. A coordinate move updates the gradient by one column of it (covariance
updates); sweeps run over the active set until it rests, then all coordinates are checked. One row per
model and penalty; models are independent and spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from onefold.operators.newton import unpack
from onefold.spec import TermSpec

MAX_SWEEPS = 100_000
# Penalties of a path, from the one that keeps all slopes at 0 down to this share of it.
STEPS = 50
LEAST_SHARE = 1e-3


def minimise(h: np.ndarray, target: np.ndarray, reg: float, mix: float, free: np.ndarray, start: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """The minimum of ``(b-t)'h(b-t)/2 + reg (mix |b|_1 + (1-mix)/2 |b|^2)``; coordinates in ``free`` carry no penalty."""
    b = start.copy()
    slope = h @ (target - b)
    diagonal = np.diag(h)
    l1, l2 = np.where(free, 0.0, reg * mix), np.where(free, 0.0, reg * (1 - mix))
    usable = diagonal > 0
    scale = max(float(np.max(np.abs(target), initial=0.0)), 1e-12)

    def sweep(which: np.ndarray) -> float:
        nonlocal slope
        most = 0.0
        for j in which:
            pull = slope[j] + diagonal[j] * b[j]
            new = np.sign(pull) * max(abs(pull) - l1[j], 0.0) / (diagonal[j] + l2[j])
            move = new - b[j]
            if move:
                slope -= h[:, j] * move
                b[j] = new
                most = max(most, abs(move))
        return most

    every = np.flatnonzero(usable)
    for _ in range(MAX_SWEEPS):
        if sweep(every) <= tol * scale:
            break
        active = np.flatnonzero(usable & ((b != 0) | free))
        for _ in range(MAX_SWEEPS):
            if sweep(active) <= tol * scale:
                break
    return b


def penalised_path(combined: DataFrame, spec: TermSpec, mix: float = 1.0, regs: Sequence[float] | None = None) -> DataFrame:
    """``keys, step, reg, beta, dof, gap``: penalised estimates of every model of a combined frame.

    The loss is per row, so ``reg`` means what it means in Spark ML. Without ``regs`` the path falls geometrically
    from the penalty at which all slopes are 0. The intercept is not penalised, each penalty
    starts from the estimate before it, and ``dof`` counts slopes that are not 0. ``gap`` is the
    largest violation of the conditions of an optimum, relative to the penalty. Models without an estimate have no rows.
    """
    keys, p = list(spec.keys), spec.p
    types = {f.name: f.dataType.simpleString() for f in combined.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "step int, reg double, beta array<double>, dof int, gap double"])
    free = np.arange(p) < int(spec.intercept)
    given = None if regs is None else [float(r) for r in regs]

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row["wlse"] is None:
                    continue
                h = unpack(np.asarray(row["hess"], float), p) / row["n_used"]
                target = np.asarray(row["wlse"], float)
                b = minimise(h, target, 1e12, 1.0, free, np.zeros(p))
                ladder = given
                if ladder is None:
                    top = float(np.max(np.abs(h @ (target - b))[~free], initial=0.0)) / max(mix, 1e-3)
                    ladder = list(top * np.geomspace(1.0, LEAST_SHARE, STEPS))
                for step, reg in enumerate(ladder):
                    b = minimise(h, target, reg, mix, free, b)
                    pull = h @ (target - b) - np.where(free, 0.0, reg * (1 - mix)) * b
                    bound = np.where(free, 0.0, reg * mix)
                    off = np.where((b != 0) | free, np.abs(pull - bound * np.sign(b)), np.maximum(np.abs(pull) - bound, 0.0))
                    gap = float(np.max(off, initial=0.0)) / max(reg, 1e-300)
                    out.append([*[row[k] for k in keys], step, reg, b.copy(), int(np.count_nonzero(b[~free])), gap])
            yield pd.DataFrame(out, columns=[*keys, "step", "reg", "beta", "dof", "gap"])

    return combined.select(*keys, "wlse", "hess", "n_used").mapInPandas(solve, schema)
