"""Chunk-level numerics: the coded design and a Newton fit. Runs inside Spark tasks."""

from __future__ import annotations

import numpy as np


class CodedDesign:
    """Design matrix of one block of rows, kept as continuous columns plus factor codes.

    Dummies are never laid out: products with a factor are weighted counts by code.
    A factor of width L has codes 0..L; code L has no term.
    """

    def __init__(self, numeric: np.ndarray, codes: list[np.ndarray], widths: list[int], intercept: bool):
        rows = len(numeric)
        self.numeric = np.column_stack([np.ones(rows), numeric]) if intercept else numeric
        self.codes = codes
        self.widths = widths
        self.at = np.cumsum([self.numeric.shape[1], *widths])
        self.p = int(self.at[-1])

    def rows(self, at: slice | np.ndarray) -> CodedDesign:
        """The design of some of the rows."""
        out = object.__new__(CodedDesign)
        out.numeric, out.codes, out.widths, out.at, out.p = self.numeric[at], [c[at] for c in self.codes], self.widths, self.at, self.p
        return out

    def dense(self) -> np.ndarray:
        """The matrix itself, for a few rows."""
        return np.hstack([self.numeric, *[np.eye(w + 1)[c][:, :w] for c, w in zip(self.codes, self.widths)]])

    def eta(self, beta: np.ndarray) -> np.ndarray:
        out = self.numeric @ beta[: self.at[0]]
        for i, code in enumerate(self.codes):
            out = out + np.append(beta[self.at[i]: self.at[i + 1]], 0.0)[code]
        return out

    def left(self, r: np.ndarray) -> np.ndarray:
        """X'r."""
        parts = [self.numeric.T @ r]
        for code, width in zip(self.codes, self.widths):
            parts.append(np.bincount(code, r, width + 1)[:width])
        return np.concatenate(parts)

    def gram(self, w: np.ndarray) -> np.ndarray:
        """X' diag(w) X."""
        out = np.zeros((self.p, self.p))
        q = self.at[0]
        weighted = self.numeric * w[:, None]
        out[:q, :q] = self.numeric.T @ weighted
        for i, (code, width) in enumerate(zip(self.codes, self.widths)):
            own = slice(self.at[i], self.at[i + 1])
            for c in range(q):
                out[c, own] = np.bincount(code, weighted[:, c], width + 1)[:width]
            out[own, own] = np.diag(np.bincount(code, w, width + 1)[:width])
            for j in range(i + 1, len(self.codes)):
                wide = self.widths[j] + 1
                cross = np.bincount(code * wide + self.codes[j], w, (width + 1) * wide)
                out[own, self.at[j]: self.at[j + 1]] = cross.reshape(width + 1, wide)[:width, :-1]
        return np.triu(out) + np.triu(out, 1).T


def logistic_sums(design: CodedDesign, beta: np.ndarray, hits: np.ndarray, trials: np.ndarray):
    """Log-likelihood, gradient and Hessian at ``beta`` for binomial rows."""
    eta = design.eta(beta)
    loglik = float(np.sum(hits * eta - trials * np.logaddexp(0.0, eta)))
    prob = np.exp(-np.logaddexp(0.0, -eta))
    return loglik, design.left(hits - trials * prob), design.gram(trials * prob * (1.0 - prob))


def newton_step(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Shortest solution; exactly 0 for terms without information."""
    some = np.flatnonzero(np.diag(hessian) > 0)
    out = np.zeros(len(gradient))
    out[some] = np.linalg.lstsq(hessian[np.ix_(some, some)], gradient[some], rcond=None)[0]
    return out


def small_step(step: np.ndarray, beta: np.ndarray, tol: float) -> bool:
    return bool(np.max(np.abs(step) / (1.0 + np.abs(beta)), initial=0.0) <= tol)


# A step is halved at most so often before a chunk counts as not converged.
MAX_HALVINGS = 40


# A direction has no optimum if its rows keep less than this share of their weight in the Hessian.
LEAST_WEIGHT = 1e-8
# Steps before separation is looked for: each one lowers the weight of a separated row by a factor of e.
CALM_STEPS = 15


def in_the_limit(beta: np.ndarray, hessian: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate and Hessian in the limit of a fit driven to infinity, and the terms that are set aside.

    Where a level is of one class, or some combination of terms tells the classes of its rows apart, the
    likelihood rises for ever along that direction. In the limit these rows fit perfectly and weigh nothing,
    and all other directions are those of the fit without them. ``gram`` is the Hessian with every row at full weight;
    the directions of recession are those in which next to nothing of it is left. They become exact zeros.
    A term is marked 1 if it is such a direction by itself, 2 if it is part of one.
    """
    squares = np.diag(gram)
    alone = (squares > 0) & (np.diag(hessian) < LEAST_WEIGHT * squares)
    aside = alone.astype(int)
    h, b = hessian.copy(), beta.copy()
    h[alone], h[:, alone], b[alone] = 0.0, 0.0, 0.0
    rest = np.flatnonzero((squares > 0) & ~alone)
    if not len(rest):
        return b, h, aside
    scale = 1.0 / np.sqrt(squares[rest])
    values, vectors = np.linalg.eigh(gram[np.ix_(rest, rest)] * scale * scale[:, None])
    known = values > 1e-9 * values[-1]
    white = scale[:, None] * vectors[:, known] / np.sqrt(values[known])
    kept, turned = np.linalg.eigh(white.T @ h[np.ix_(rest, rest)] @ white)
    gone = white @ turned[:, kept < LEAST_WEIGHT]
    if gone.shape[1]:
        # Directions that mix terms: project them out of estimate and Hessian.
        basis = np.linalg.svd(gone * np.sqrt(squares[rest])[:, None], full_matrices=False)[0] * scale[:, None]
        basis = np.linalg.qr(basis)[0]
        out = np.eye(len(rest)) - basis @ basis.T
        h[np.ix_(rest, rest)] = out @ h[np.ix_(rest, rest)] @ out
        b[rest] = out @ b[rest]
        aside[rest] = 2 * (np.abs(basis).max(axis=1) > 1e-6)
    return b, h, aside


def newton_fit(design: CodedDesign, hits, trials, max_iter: int = 100, tol: float = 1e-12):
    """Unpenalised maximum likelihood: ``(beta, hessian, loglik, iterations, converged)``.

    A step that lowers the likelihood is halved, so near-separated chunks do not diverge.
    Columns without a row (an absent level) stay at 0: the step is the shortest of all solutions.
    Of separated rows the weight falls until they no longer count; see ``in_the_limit``.
    """
    beta = np.zeros(design.p)
    loglik, gradient, hessian = logistic_sums(design, beta, hits, trials)
    for iteration in range(1, max_iter + 1):
        step = newton_step(gradient, hessian)
        done = small_step(step, beta, tol)
        for _ in range(MAX_HALVINGS):
            trial = logistic_sums(design, beta + step, hits, trials)
            if np.isfinite(trial[0]) and trial[0] >= loglik - 1e-10 * (1.0 + abs(loglik)):
                break
            step = step / 2.0
        else:
            return beta, hessian, loglik, iteration, False
        beta = beta + step
        loglik, gradient, hessian = trial
        if done:
            return beta, hessian, loglik, iteration, True
    return beta, hessian, loglik, max_iter, False


def pack(h: np.ndarray) -> np.ndarray:
    """Upper triangle, row by row."""
    return h[np.triu_indices(len(h))]


def unpack(values: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = values
    return out + np.triu(out, 1).T
