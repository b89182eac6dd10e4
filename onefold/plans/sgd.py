"""Averaged mini-batch SGD for logistic regression, run on all partitions and averaged per epoch."""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.operators.chunkfit import _Layout, coded_rows, sum_arrays
from onefold.operators.chunks import CHUNK
from onefold.sources.store import load_spec, load_table, save_model
from onefold.spec import TermSpec


# Rows of a part; a task of a barrier stage holds one in memory, some 100 MB.
PART_ROWS = 1_000_000
LEAST_PARTS = 8

# Bytes of rows that a task deals out at a time, and bytes of rows that a part brings into random order at a time.
DEAL_BYTES = 16_000_000
ORDER_BYTES = 64_000_000
BLOCK_ROWS = 10_000


# Distinct predictor rows of a block up to which a mini-batch is held as sums per distinct row.
MAX_SUMMED = 32


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The same numbers in one byte each where they are counts up to 255; every pass reads them again."""
    small = counts.astype(np.uint8) if len(counts) and 0 <= counts.min() and counts.max() <= 255 else counts
    return small if np.array_equal(small, counts) else counts


class _Block:
    """Some rows, cut into mini-batches once for all passes.

    Without continuous columns rows repeat: a mini-batch is then its hits and trials per distinct row, which
    gives the same slopes from fewer numbers.
    """

    def __init__(self, layout: _Layout, pdf: pd.DataFrame, batch_rows: int):
        hits, trials = pdf["hits"].to_numpy(float), pdf["trials"].to_numpy(float)
        self.low = np.arange(0, len(pdf), batch_rows)
        self.high = np.append(self.low[1:], len(pdf))
        self.size = np.add.reduceat(trials, self.low)
        self.design, self.distinct, self.hits, self.trials = layout.design(pdf), None, _narrow(hits), _narrow(trials)
        if layout.continuous:
            self.design.codes = [_narrow(c) for c in self.design.codes]
            return
        rows = np.zeros(len(pdf), np.int64)
        for code, width in zip(self.design.codes, layout.widths, strict=True):
            # Numbered anew after each factor, so the numbers stay below rows times width.
            rows = np.unique(rows * (width + 1) + code, return_inverse=True)[1].astype(np.int64)
        _, first, of = np.unique(rows, return_index=True, return_inverse=True)
        k = len(first)
        if k > min(MAX_SUMMED, batch_rows):
            return
        cell = np.arange(len(pdf)) // batch_rows * k + of
        shape = (len(self.low), k)
        self.hits = np.bincount(cell, hits, shape[0] * k).reshape(shape)
        self.trials = np.bincount(cell, trials, shape[0] * k).reshape(shape)
        self.distinct, self.design = self.design.rows(first).dense(), None

    def descend(self, beta: np.ndarray, mean: np.ndarray, rate: float, steps: int) -> tuple[np.ndarray, int]:
        """The coefficients and number of steps after this block; ``mean`` is moved in place."""
        at = np.arange(steps + 1, steps + 1 + len(self.size))
        scale = rate / np.sqrt(at) / self.size
        path = np.empty((len(at), len(beta)))
        if self.distinct is not None:
            self._summed_path(path, beta, scale)
        else:
            for i, step in enumerate(scale):
                part = slice(self.low[i], self.high[i])
                design = self.design.rows(part)
                prob = np.exp(-np.logaddexp(0.0, -design.eta(beta)))
                beta = np.add(beta, step * design.left(self.hits[part] - self.trials[part] * prob), path[i])
        # Later steps weigh more, so the way in from the start fades out of the average.
        share = 4.0 / (at + 3.0)
        after = np.append(np.cumprod((1.0 - share)[::-1])[::-1], 1.0)
        mean *= after[0]
        mean += (share * after[1:]) @ path
        return path[-1].copy(), steps + len(at)

    def _summed_path(self, path: np.ndarray, beta: np.ndarray, scale: np.ndarray) -> None:
        """The coefficients after each mini-batch; with p = (1 + tanh(eta / 2)) / 2 a step on beta / 2 is a few products."""
        pull = scale[:, None] * (self.hits / 2 - self.trials / 4)
        weight = scale[:, None] * (self.trials / 4)
        x = self.distinct
        plain = x.shape[0] == x.shape[1] and np.array_equal(x, np.eye(len(x)))
        half, move = beta / 2, np.empty(len(x))
        for a, b, now in zip(pull, weight, path):
            np.tanh(half if plain else x @ half, move)
            np.multiply(b, move, move)
            np.subtract(a, move, move)
            half = np.add(half, move if plain else move @ x, now)
        path *= 2


def _descend(blocks: Iterable[_Block], start: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
    """One pass over some rows: the average of the steps and the rows seen."""
    beta, mean, seen, steps = start, np.zeros(len(start)), 0.0, 0
    for block in blocks:
        beta, steps = block.descend(beta, mean, rate, steps)
        seen += block.size.sum()
    return mean, seen


def _record(layout: _Layout) -> np.dtype:
    """A coded row of one trial; a code takes as many bytes as its factor needs."""
    codes = [(c, np.min_scalar_type(w)) for c, w in zip(layout.codes, layout.widths, strict=True)]
    return np.dtype([*[(c, "f8") for c in layout.continuous], *codes, ("hits", "f8")])


def _taken(records: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Some of the records, each moved as a whole and not field by field."""
    return records.view(f"V{records.itemsize}").take(at).view(records.dtype)


def _runs(arrays: Iterable[np.ndarray], rows: int) -> Iterator[np.ndarray]:
    """Joined until there are at least so many rows."""
    held, n = [], 0
    for a in filter(len, arrays):
        held.append(a)
        n += len(a)
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def dealt_rows(rows: DataFrame, spec: TermSpec, seed: int, parts: int) -> DataFrame:
    """Coded rows of one trial dealt evenly and at random over ``parts`` partitions, as ``rows``: packs of records.

    A task draws the order of its rows some megabytes at a time and sends every part what falls to it as one pack, so the
    shuffle moves a few packs and not single rows. A lost task draws the same again, where its rows come in the same order.
    """
    record = _record(_Layout(spec))

    def records(batches):
        for batch in batches:
            values = batch.column("row").flatten().to_numpy().reshape(batch.num_rows, -1)
            out = np.empty(len(values), record)
            for i, c in enumerate(record.names):
                out[c] = values[:, i]
            yield out

    def deal(batches):
        rng = np.random.default_rng([abs(seed), TaskContext.get().partitionId()])
        for run in _runs(records(batches), DEAL_BYTES // record.itemsize):
            run, first = _taken(run, rng.permutation(len(run))), rng.integers(parts)
            some = min(parts, len(run))
            yield pa.RecordBatch.from_arrays([
                pa.array((first + np.arange(some)) % parts, pa.int32()), pa.array(rng.integers(0, 2**63, some, np.int64)),
                pa.array([run[i::parts].tobytes() for i in range(some)], pa.binary())], ["part", "turn", "rows"])

    # One array per row: Arrow batches of many columns take several times as long to fill.
    narrow = rows.select(F.array(*[F.col(c).cast("double") for c in record.names]).alias("row"))
    packs = narrow.mapInArrow(deal, "part int, turn bigint, rows binary")
    return packs.repartitionById(parts, "part").sortWithinPartitions("turn").select("rows")


def _in_random_order(batches: Iterable[pa.RecordBatch], layout: _Layout, seed: int) -> Iterator[pd.DataFrame]:
    """The dealt rows of a part, ``BLOCK_ROWS`` at a time.

    A part of up to ``ORDER_BYTES`` is brought into random order as a whole; a larger one has its packs in random order and
    the rows of neighbouring packs in random order.
    """
    record = _record(layout)
    rng = np.random.default_rng([abs(seed), 1, TaskContext.get().partitionId()])
    packs = (np.frombuffer(pack.as_buffer(), record) for batch in batches for pack in batch.column("rows"))
    for run in _runs(packs, ORDER_BYTES // record.itemsize):
        order = rng.permutation(len(run))
        for low in range(0, len(run), BLOCK_ROWS):
            part = _taken(run, order[low: low + BLOCK_ROWS])
            yield pd.DataFrame({c: part[c] for c in record.names}).assign(trials=1.0)


def _frames(batches: Iterable[pa.RecordBatch], layout: _Layout, seed: int | None) -> Iterator[pd.DataFrame]:
    """Coded rows as frames: those dealt out with ``seed``, or without one the rows as they come."""
    if seed is None:
        return (batch.to_pandas() for batch in batches if batch.num_rows)
    return _in_random_order(batches, layout, seed)


def row_blocks(rows: DataFrame, spec: TermSpec, batch_rows: int, seed: int | None, theta: Sequence[float], rate: float) -> DataFrame:
    """Coded rows as ``block``, one binary value for some thousand rows; a pass reads these as they are.

    The first pass is made as they are cut: a last row of every task has its ``sums``.
    """
    layout = _Layout(spec)
    start = np.asarray(theta, float)

    def pack(batches):
        kinds = pa.schema([("block", pa.binary()), ("sums", pa.list_(pa.float64()))])
        beta, mean, seen, steps = start, np.zeros(len(start)), 0.0, 0
        for pdf in _frames(batches, layout, seed):
            block = _Block(layout, pdf, batch_rows)
            yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(block, protocol=5)], "sums": [None]}, kinds)
            beta, steps = block.descend(beta, mean, rate, steps)
            seen += block.size.sum()
        if seen:
            yield pa.RecordBatch.from_pydict({"block": [None], "sums": [np.append(mean * seen, seen)]}, kinds)

    return rows.mapInArrow(pack, "block binary, sums array<double>")


def averaged(sums: DataFrame, spec: TermSpec) -> DataFrame:
    """The coefficients of all tasks by the rows they have seen."""
    total = sum_arrays(sums, [], F.col("sums"), "sums").filter(F.size("sums") > 0)
    weight = F.element_at("sums", -1)
    return total.select(
        F.transform(F.slice("sums", 1, spec.p), lambda s: s / weight).alias("theta"))


def sgd_epoch(blocks: DataFrame, spec: TermSpec, theta: Sequence[float], rate: float) -> DataFrame:
    """Each task runs over the mini-batches of its own ``row_blocks``; one weighted average comes back.

    No shuffle and no gathering of rows: a task streams the blocks of its partition,
    and only p + 1 numbers per task are summed.
    """
    start = np.asarray(theta, float)

    def descend(batches):
        mean, seen = _descend((pickle.loads(b.as_buffer()) for batch in batches for b in batch.column("block") if b.is_valid), start, rate)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(mean * seen, seen)])], ["sums"])

    return averaged(blocks.select("block").mapInArrow(descend, "sums array<double>"), spec)


def _barrier_epochs(rows: DataFrame, spec: TermSpec, theta: Sequence[float], epochs: int, rate: float, batch_rows: int,
                    seed: int | None) -> list[float]:
    """All passes in one stage: every task holds its rows and hands p + 1 numbers to all others after a pass."""
    layout = _Layout(spec)
    start = np.asarray(theta, float)

    def run(batches):
        context = BarrierTaskContext.get()
        held = [_Block(layout, pdf, batch_rows) for pdf in _frames(batches, layout, seed)]
        now = start
        for epoch in range(epochs):
            mean, seen = _descend(held, now, rate / float(np.sqrt(1.0 + epoch)))
            told = [np.array(json.loads(m)) for m in context.allGather(json.dumps([*(mean * seen), seen]))]
            sums = np.sum(told, axis=0)
            if sums[-1]:
                now = sums[:-1] / sums[-1]
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([now])], ["theta"])

    return list(rows.mapInArrow(run, "theta array<double>", barrier=True).collect()[0]["theta"])


def save_sgd(df: DataFrame, folder: str, spec: TermSpec, theta: Sequence[float]) -> None:
    """Store the coefficients of a run with their terms; ``df`` gives the session."""
    rows = [(t, "sgd", float(b)) for t, b in zip(spec.terms, theta, strict=True)]
    save_model(folder, spec, coef=df.sparkSession.createDataFrame(rows, "term string, method string, estimate double"))


def load_sgd(df: DataFrame, folder: str) -> tuple[TermSpec, list[float]]:
    """Terms and coefficients of a stored run, to go on from with ``fit_sgd(warm=...)``."""
    spec = load_spec(df.sparkSession, folder)
    known = {r["term"]: r["estimate"] for r in load_table(df.sparkSession, folder, "coef").filter("method = 'sgd'").collect()}
    return spec, [known[t] for t in spec.terms]


def fit_sgd(df: DataFrame, spec: TermSpec, epochs: int = 5, rate: float = 2.0, batch_rows: int = 256,
            warm: Sequence[float] | None = None, shuffle_seed: int | None = 1, parts: int | None = None,
            storage: StorageLevel = StorageLevel.DISK_ONLY, barrier: bool | None = None) -> list[float]:
    """Coefficients in term order after ``epochs`` passes; ``warm`` continues an earlier run.

    The narrow coded rows are dealt out once
    (``shuffle_seed=None`` takes them as they come) over ``parts`` partitions, each of which
    descends on its own; without ``parts`` there is one for every ``PART_ROWS`` rows, and at least ``LEAST_PARTS``. Where all
    parts can run at once, all passes are one barrier stage: a task keeps its coded rows, and after each pass the tasks
    exchange p + 1 numbers among themselves. Else every pass is a job over persisted
    blocks of them, and the p coefficients travel through the driver. Both give the same averages.
    """
    if spec.keys:
        raise ValueError("one model only")
    rows = df if CHUNK in df.columns else df.withColumn(CHUNK, F.lit(0))
    rows = coded_rows(rows, spec, compress=False).drop(CHUNK)
    slots = df.sparkSession.sparkContext.defaultParallelism
    if parts is None:
        parts = max(LEAST_PARTS, -(-df.count() // PART_ROWS))
    if shuffle_seed is not None:
        rows = dealt_rows(rows, spec, shuffle_seed, parts)
    theta = [0.0] * spec.p if warm is None else list(warm)
    if barrier or (barrier is None and shuffle_seed is not None and parts <= slots):
        return _barrier_epochs(rows, spec, theta, epochs, rate, batch_rows, shuffle_seed)
    blocks = row_blocks(rows, spec, batch_rows, shuffle_seed, theta, rate).persist(storage)
    for epoch in range(epochs):
        step = rate / float(np.sqrt(1.0 + epoch))
        moved = sgd_epoch(blocks, spec, theta, step) if epoch else averaged(blocks.select("sums"), spec)
        theta = list(moved.first()["theta"])
    blocks.unpersist()
    return theta
