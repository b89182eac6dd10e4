"""A linear-chain conditional random field in numpy: maximum likelihood and Viterbi over many sequences at once.

Sequences lie end to end; ``first[i]:first[i + 1]`` are the positions of sequence ``i``. They are handled
longest first, so that one step works on all sequences that are still running, without padding.
"""

from __future__ import annotations

import numpy as np

# Score of a transition that the labels do not allow.
FORBIDDEN = -1e4


def _order(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the sequences, longest first, and how many run at each step."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    steps = int(size.max(initial=0))
    running = len(size) - np.searchsorted(np.sort(size), np.arange(steps), side="right")
    return first[:-1][order], running


def viterbi(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The label of each position on the best path of its sequence; ties go to the smaller label."""
    begin, running = _order(first)
    best = np.empty(len(emission), np.int64)
    if not len(running):
        return best
    back = np.zeros(emission.shape, np.int16)
    score = start + emission[begin[:running[0]]]
    ends = np.zeros(len(begin), np.int64)
    for t in range(1, len(running)):
        n = running[t]
        ends[n:running[t - 1]] = np.argmax(score[n:], axis=1)
        ways = score[:n, :, None] + transition
        back[begin[:n] + t] = ways.argmax(axis=1)
        score = ways.max(axis=1) + emission[begin[:n] + t]
    ends[:running[-1]] = np.argmax(score, axis=1)
    label = ends
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        best[begin[:n] + t] = label[:n]
        if t:
            label[:n] = back[begin[:n] + t, label[:n]]
    return best


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the log partition functions, label probabilities per position, expected transitions in all."""
    begin, running = _order(first)
    ahead, behind = np.empty(emission.shape), np.zeros(emission.shape)
    total, pairs = 0.0, np.zeros(transition.shape)
    if not len(running):
        return total, ahead, pairs
    ahead[begin[:running[0]]] = start + emission[begin[:running[0]]]
    for t in range(1, len(running)):
        at = begin[:running[t]] + t
        ahead[at] = _logsum(ahead[at - 1][:, :, None] + transition, 1) + emission[at]
    last = np.repeat(np.arange(len(running)), running - np.append(running[1:], 0))[::-1]
    whole = _logsum(ahead[begin[:running[0]] + last], 1)
    for t in range(len(running) - 1, 0, -1):
        n = running[t]
        at = begin[:n] + t
        coming = transition + (emission[at] + behind[at])[:, None, :]
        behind[at - 1] = _logsum(coming, 2)
        pairs += np.exp(ahead[at - 1][:, :, None] + coming - whole[:n, None, None]).sum(axis=0)
    norm = np.zeros(len(emission))
    for t in range(len(running)):
        norm[begin[:running[t]] + t] = whole[:running[t]]
    return float(whole.sum()), np.exp(ahead + behind - norm[:, None]), pairs


def fit(ids: np.ndarray, n_features: int, gold: np.ndarray, first: np.ndarray, allowed: np.ndarray, starts: np.ndarray,
        l2: float = 0.05, steps: int = 150, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature weights, transitions and start scores that maximise the penalised likelihood.

    ``ids`` holds the features of each position, padded with ``n_features``. ``allowed`` and ``starts`` mark the
    transitions and first labels there may be. A fixed number of falling steps (Adam), no randomness.
    """
    labels = len(starts)
    theta = np.zeros((n_features + 1 + labels + 1, labels))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros_like(theta)
    flat = ids.ravel()
    hot = np.eye(labels)[gold]
    np.add.at(seen, flat, np.repeat(hot, ids.shape[1], axis=0))
    heads = first[:-1][np.diff(first) > 0]
    inner = np.setdiff1d(np.arange(len(gold)), heads)
    np.add.at(seen[n_features + 1:-1], (gold[inner - 1], gold[inner]), 1.0)
    seen[-1] = hot[heads].sum(axis=0)
    for step in range(1, steps + 1):
        weight, transition, start = theta[:n_features + 1], theta[n_features + 1:-1], theta[-1]
        _, p, pairs = marginals(
            weight[ids].sum(axis=1), first, np.where(allowed, transition, FORBIDDEN), np.where(starts, start, FORBIDDEN))
        expected = np.zeros_like(theta)
        np.add.at(expected, flat, np.repeat(p, ids.shape[1], axis=0))
        expected[n_features + 1:-1] = pairs
        expected[-1] = p[heads].sum(axis=0)
        slope = seen - expected - l2 * theta
        slope[n_features] = 0.0
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        theta = theta + rate * (1 - (step - 1) / steps) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], np.where(allowed, theta[n_features + 1:-1], FORBIDDEN), np.where(starts, theta[-1], FORBIDDEN)
