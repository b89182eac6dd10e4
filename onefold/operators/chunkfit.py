"""One logistic fit per (model, chunk), shipping only (coefficients, moment, Hessian).

Chunks are bounded by design (rows per chunk), so a chunk is fitted in one task. A chunk
that is larger than one task should hold - a hot key given as chunk number, say - is cut
over many tasks and fitted to the same optimum by summing Newton terms over the pieces.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onefold.functions import has_nan
from onefold.operators.chunks import CHUNK
from onefold.operators.newton import (
    CALM_STEPS, MAX_HALVINGS, CodedDesign, in_the_limit, logistic_sums, newton_fit, newton_step, pack, small_step, unpack,
)
from onefold.operators.prepare import coded, complete_rows, standardise_columns
from onefold.session import BROADCAST_ROWS, settle, small_side, stage
from onefold.spec import TermSpec

# A chunk of more rows than this is not given to one task.
ROWS_PER_TASK = 2_000_000
# Rows are added up by predictors first if there are at most this many combinations.
MAX_PATTERNS = 100_000

_BODY = (
    "n bigint, hits double, status string, iterations int, loglik double, "
    "theta array<double>, v array<double>, hess array<double>, aside array<double>, aside_hits array<double>"
)


def coded_rows(df: DataFrame, spec: TermSpec, compress: bool | None = None) -> DataFrame:
    """The narrow frame the fit works on: keys, chunk, continuous columns, codes, hits, trials.

    Rows with a null in any of them or with an unseen level are left out, here as in the
    log-likelihood; ``prepare.unseen_rows`` counts the latter.
    ``compress`` adds up rows with equal predictors first, which is exact for a logistic
    likelihood. By default it is used when there are few level combinations and no continuous
    columns: the rows then vanish on the map side and never reach a shuffle.
    """
    rows = standardise_columns(coded(complete_rows(df, spec), spec), dict(spec.scales))
    codes = [f"code_{f.name}" for f in spec.factors]
    by = [*spec.keys, CHUNK, *spec.continuous, *codes]
    narrow = rows.select(
        *[F.col(c) for c in (*spec.keys, CHUNK)],
        *[F.col(c).cast("double").alias(c) for c in spec.continuous],
        *codes,
        F.col(spec.response).cast("double").alias("hits"),
        F.lit(1.0).alias("trials"),
    )
    if compress is None:
        compress = patterns(spec) <= MAX_PATTERNS
    if compress:
        narrow = narrow.groupBy(*by).agg(F.sum("hits").alias("hits"), F.sum("trials").alias("trials"))
    return narrow


def patterns(spec: TermSpec) -> float:
    """Largest number of distinct predictor rows."""
    return math.inf if spec.continuous else math.prod(w + 1 for w in spec.widths)


def fit_chunks(
    df: DataFrame,
    spec: TermSpec,
    compress: bool | None = None,
    rows_per_task: int | None = ROWS_PER_TASK,
    max_iter: int = 100,
    tol: float = 1e-12,
    pool: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Fit every chunk; one summary row per (model keys, chunk).

    ``hess`` is the upper triangle of X'diag(n p (1-p))X, row by row; ``v`` is Hessian times
    theta. A level without rows in the chunk has 0 in theta, v and its part of the Hessian, so
    it adds nothing when chunks are combined. Where a level is of one class in its chunk (or a
    combination of terms separates rows) the fit is that of the limit: these rows are fitted perfectly,
    the term is 0 like an absent one and all other terms are as without them. ``aside`` then holds the rows
    set aside per term and ``aside_hits`` their hits (NaN for a term that is only part of a
    direction); else both are null. Such rows move to a chunk where
    their level has both classes, if there is one, and only that chunk is fitted again.

    Chunks that are wholly of one class, or wholly separated, are
    pooled with others of their model until all rows are used; a pool has the smallest number
    of its chunks. What is left is a model that has no optimum on all of its rows: its
    ``status`` is ``one_class`` or ``not_converged`` instead of ``ok`` and it has no arrays.
    ``rows_per_task=None`` skips the size check, for chunk numbers that are bounded by
    construction; pools are always checked. ``tasks`` deals chunks that are not added up first
    over so many tasks: a fit costs more than its bytes tell adaptive execution.
    """
    rows = coded_rows(df, spec, compress)
    if tasks is not None and not (compress or (compress is None and patterns(spec) <= MAX_PATTERNS)):
        rows = rows.repartition(tasks, *spec.keys, CHUNK)
    first = _fit_sized(rows, spec, compress, rows_per_task, max_iter, tol)
    if not pool:
        return first
    state = settle(first)
    found = state.agg(F.count_if(F.col("status") != "ok").alias("bad"), F.count("aside").alias("aside")).first()

    def refit(again: DataFrame) -> DataFrame:
        limit = ROWS_PER_TASK if rows_per_task is None else rows_per_task
        return _fit_sized(again, spec, compress, limit, max_iter, tol)

    if found["bad"]:
        state, place = _pool_unusable(rows, state, spec, refit)
        rows = rows.join(small_side(settle(place)), [*spec.keys, CHUNK]).drop(CHUNK).withColumnRenamed("__pool", CHUNK).select(*rows.columns)
    if found["bad"] or found["aside"]:
        state = _move_aside(rows, state, spec, refit)
    return state


def _own(hits: str) -> Column:
    """Whether a term was set aside by itself, so that its rows are known."""
    return ~F.coalesce(F.isnan(hits), F.lit(True))


def one_class_terms(summary: DataFrame, spec: TermSpec, everywhere: bool = True) -> DataFrame:
    """``keys, term, n, hits``: levels set aside in every chunk that has rows of them, or in some; ``term`` counts from 0."""
    p = spec.p
    diagonal = F.array(*[F.lit(i * p - i * (i - 1) // 2) for i in range(p)])
    zeros = F.array_repeat(F.lit(0.0), p)
    cells = summary.filter("theta IS NOT NULL").select(*spec.keys, F.posexplode(F.arrays_zip(
        F.coalesce("aside", zeros).alias("n"), F.coalesce("aside_hits", zeros).alias("hits"),
        F.transform(diagonal, lambda i: F.get("hess", i)).alias("h"))).alias("term", "c"))
    own = _own("c.hits")
    found = cells.groupBy(*spec.keys, "term").agg(
        F.sum(F.when(own, F.col("c.n"))).alias("n"), F.sum(F.when(own, F.col("c.hits"))).alias("hits"),
        F.max(~own | ((F.col("c.n") == 0) & (F.col("c.h") > 0))).alias("alive"))
    return found.filter("n > 0 AND NOT alive" if everywhere else "n > 0").drop("alive")


# Rounds in which rows that were set aside move to other chunks.
_MOVES = 3


def _move_aside(rows: DataFrame, state: DataFrame, spec: TermSpec, refit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Move rows set aside for their level to chunks of the model where the level has both classes.

    Which chunk a row lies in is free, and adding rows never separates what is not separated. The fit of
    the chunk they leave does not change, since it is the fit without them; those that take them are fitted again.
    A level with rows of both classes but in no chunk of both is brought together where its hits are.
    A moved row may bring a level that is new to its chunk, so there are up to three rounds. A level of one
    class in all chunks moves nowhere.
    """
    group, p = [*spec.keys, CHUNK], spec.p
    model = [F.col(k).alias(f"__k{i}") for i, k in enumerate(spec.keys)]
    keys = [f"__k{i}" for i in range(len(spec.keys))]
    for _ in range(_MOVES):
        cells = state.filter(F.col("aside").isNotNull()).select(*model, F.col(CHUNK).alias("__from"), F.posexplode("aside").alias("__term", "__n"),
                                                                 "aside_hits")
        cells = cells.withColumn("__hits", F.expr("aside_hits[__term]")).drop("aside_hits")
        donors = settle(cells.filter((F.col("__n") > 0) & _own("__hits")))
        if donors.isEmpty():
            return state
        # Chunks in which a wanted term is alive; without keys there is one model.
        wanted = donors.groupBy(*keys, F.lit(1).alias("__m")).agg(F.collect_set("__term").alias("__terms"))
        diagonal = F.array(*[F.lit(i * p - i * (i - 1) // 2) for i in range(p)])
        alive = state.filter("status = 'ok'").select(
            *model, F.lit(1).alias("__m"), F.col(CHUNK).alias("__to"),
            F.transform(diagonal, lambda i: F.get("hess", i)).alias("__h"), F.coalesce("aside", F.array_repeat(F.lit(0.0), p)).alias("__a"))
        alive = alive.join(small_side(settle(wanted)), [*keys, "__m"]).select(*keys, "__to", "__h", "__a", F.explode("__terms").alias("__term"))
        takers = alive.filter(F.expr("__h[__term] > 0 and __a[__term] = 0")).select(*keys, "__term", "__to")
        per_term = Window.partitionBy(*keys, "__term")
        ones = donors.withColumn("__all", F.sum("__n").over(per_term)).withColumn("__all_hits", F.sum("__hits").over(per_term)).filter(
            (F.col("__all_hits") > 0) & (F.col("__all_hits") < F.col("__all")) & (F.col("__hits") > 0))
        takers = settle(takers.unionByName(ones.join(takers, [*keys, "__term"], "left_anti").select(*keys, "__term", F.col("__from").alias("__to"))))
        numbered = takers.withColumn("__i", F.row_number().over(per_term.orderBy("__to")) - 1).withColumn("__many", F.count("*").over(per_term))
        giving = donors.join(takers.withColumnRenamed("__to", "__from"), [*keys, "__term", "__from"], "left_anti")
        giving = giving.join(takers.groupBy(*keys, "__term").agg(F.count("*").alias("__many")), [*keys, "__term"])
        giving = giving.withColumn("__i", (F.row_number().over(per_term.orderBy("__from")) - 1) % F.col("__many")).drop("__many")
        moves = settle(giving.join(numbered.drop("__many"), [*keys, "__term", "__i"]).select(*keys, "__term", "__from", "__to"))
        if moves.isEmpty():
            return state
        placed, to = rows, []
        for f in spec.factors:
            at, width = spec.offset(f), len(f.slots)
            own = settle(moves.filter(F.col("__term").between(at, at + width - 1)))
            if own.isEmpty():
                continue
            to.append(f"__to_{len(to)}")
            names = [F.col(k).alias(n) for k, n in zip(keys, spec.keys, strict=True)]
            placed = placed.join(small_side(own.select(*names, F.col("__from").alias(CHUNK), (F.col("__term") - at).cast("int").alias(f"code_{f.name}"),
                                                       F.col("__to").alias(to[-1]))), [*group, f"code_{f.name}"], "left")
        back = {n: k for k, n in zip(spec.keys, keys, strict=True)}
        taking = small_side(settle(moves.select(*keys, F.col("__to").alias(CHUNK)).distinct().withColumnsRenamed(back)))
        placed = placed.withColumn("__to", F.coalesce(*to))
        gone = placed.filter(F.col("__to").isNotNull())
        left = settle(gone.groupBy(*group).agg(F.sum("trials").alias("__n"), F.sum("hits").alias("__hits")))
        given = settle(moves.groupBy(*keys, F.col("__from").alias(CHUNK)).agg(F.collect_set("__term").alias("__terms")).withColumnsRenamed(back))
        stay = placed.filter(F.col("__to").isNull()).join(taking, group, "left_semi")
        again = gone.drop(CHUNK).withColumnRenamed("__to", CHUNK).select(*rows.columns).unionByName(stay.select(*rows.columns))
        fitted = refit(again)
        # The chunks that gave rows keep their fit and lose the rows.
        kept = state.join(taking, group, "left_anti").join(small_side(left), group, "left").join(small_side(given), group, "left")
        clear = F.transform("aside", lambda x, i: F.when(F.array_contains("__terms", i), 0.0).otherwise(x))
        kept = kept.withColumns({
            "n": (F.col("n") - F.coalesce("__n", F.lit(0.0))).cast("bigint"), "hits": F.col("hits") - F.coalesce("__hits", F.lit(0.0)),
            "aside": F.when(F.col("__terms").isNull(), F.col("aside")).otherwise(clear)})
        kept = kept.withColumn("aside", F.when(F.exists("aside", lambda x: x > 0), F.col("aside")))
        kept = kept.withColumn("aside_hits", F.when(F.col("aside").isNotNull(), F.col("aside_hits")))
        state = settle(kept.select(*state.columns).unionByName(fitted.select(*state.columns)))
        placed = placed.withColumn(CHUNK, F.coalesce("__to", CHUNK))
        rows = placed.select(*rows.columns)
    return state


def _pool_unusable(rows: DataFrame, state: DataFrame, spec: TermSpec, refit: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Refit unusable chunks together, with more and more usable ones where that is not enough.

    Only rows of the chunks in a pool are read again. Rounds double the usable chunks taken, so
    there are at most as many as the number of chunks has bits. Also returned is the pool of each chunk.
    """
    group = [*spec.keys, CHUNK]
    # Which chunk each original chunk is in now.
    place = state.select(*group, F.col(CHUNK).alias("__pool"))
    taken, alone = 0, None
    while True:
        usable = F.col("status") == "ok"
        model = Window.partitionBy(*spec.keys)
        facts = state.select(
            *group, usable.alias("__ok"), F.count_if(~usable).over(model).alias("__bad"), F.count("*").over(model).alias("__all"),
            F.row_number().over(model.orderBy(usable, "n", CHUNK)).alias("__rank"))
        # One unusable chunk needs company at once; a model that is one chunk has no more to give.
        extra = F.greatest(F.lit(taken), F.when(F.col("__bad") == 1, 1).otherwise(0))
        pools = facts.filter((F.col("__bad") > 0) & (F.col("__all") > 1) & (F.col("__rank") <= F.col("__bad") + extra))
        pools = settle(pools.withColumn("__to", F.min(CHUNK).over(model)).select(*group, "__to"))
        if pools.isEmpty():
            return state, place
        moves = pools.withColumnRenamed(CHUNK, "__pool")
        place = settle(place.join(small_side(moves), [*spec.keys, "__pool"], "left").select(
            *group, F.coalesce("__to", "__pool").alias("__pool"), F.col("__to").isNotNull().alias("__moved")))
        again = rows.join(small_side(place.filter("__moved").select(*group, "__pool")), group)
        again = again.drop(CHUNK).withColumnRenamed("__pool", CHUNK).select(*rows.columns)
        fitted = refit(again)
        state = settle(state.join(small_side(pools.select(*group)), group, "left_anti").unionByName(fitted))
        place = place.drop("__moved")
        taken = max(1, 2 * taken)


def _fit_sized(rows: DataFrame, spec: TermSpec, compress: bool | None, rows_per_task: int | None,
               max_iter: int, tol: float) -> DataFrame:
    """Fit coded rows, large chunks in pieces."""
    group = [*spec.keys, CHUNK]
    hot = None
    added_up = compress or (compress is None and patterns(spec) <= MAX_PATTERNS)
    if rows_per_task is not None and not (added_up and patterns(spec) <= rows_per_task):
        sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
        hot = settle(sizes.filter(F.col("__rows") > rows_per_task))
        if hot.isEmpty():
            hot = None
    if hot is None:
        return _with_quality(_fit_in_one_task(rows, spec, max_iter, tol), spec)
    known = small_side(hot.select(*group))
    small = rows.join(known, group, "left_anti")
    large = rows.join(small_side(hot), group)
    return _with_quality(
        _fit_in_one_task(small, spec, max_iter, tol).unionByName(
            _fit_in_pieces(large, spec, max_iter, tol)), spec)


def _with_quality(out: DataFrame, spec: TermSpec) -> DataFrame:
    bad = F.coalesce(has_nan(F.concat("theta", "v", "hess")), F.lit(False))
    return out.withColumn("has_nan", bad)


def _schema(df: DataFrame, group: list[str], body: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*[f"`{g}` {types[g]}" for g in group], body])


class _Layout:
    """What a task needs to know of the spec; plain values, cheap to ship."""

    def __init__(self, spec: TermSpec):
        self.continuous = list(spec.continuous)
        self.codes = [f"code_{f.name}" for f in spec.factors]
        self.widths = spec.widths
        self.intercept = spec.intercept
        self.p = spec.p

    def design(self, pdf: pd.DataFrame) -> CodedDesign:
        numeric = pdf[self.continuous].to_numpy(float).reshape(len(pdf), -1)
        codes = [pdf[c].to_numpy(np.int64) for c in self.codes]
        return CodedDesign(numeric, codes, self.widths, self.intercept)

    def block_design(self, row: dict) -> CodedDesign:
        """Design of a block stored as arrays."""
        n = len(row["hits"])
        numeric = np.array([row[c] for c in self.continuous], float).reshape(-1, n).T
        return CodedDesign(numeric, [np.asarray(row[c], np.int64) for c in self.codes], self.widths,
                           self.intercept)


def _fit_rows(layout: _Layout, pdf: pd.DataFrame, max_iter: int, tol: float) -> list:
    """The body of one summary row."""
    design = layout.design(pdf)
    hits, trials = pdf["hits"].to_numpy(float), pdf["trials"].to_numpy(float)
    n, ones = trials.sum(), hits.sum()
    nothing = [None] * 5
    if ones == 0 or ones == n:
        return [int(n), ones, "one_class", 0, None, *nothing]
    beta, h, loglik, iterations, good = newton_fit(design, hits, trials, max_iter, tol)
    if not good:
        return [int(n), ones, "not_converged", iterations, loglik, *nothing]
    if iterations < CALM_STEPS:
        return [int(n), ones, "ok", iterations, loglik, beta, h @ beta, pack(h), None, None]
    result = _limit_arrays(layout, beta, h, design.gram(trials), design.left(trials), design.left(hits), n)
    return [int(n), ones, "not_converged" if result[0] is None else "ok", iterations, loglik, *result]


def _limit_arrays(layout: _Layout, beta: np.ndarray, hessian: np.ndarray, gram: np.ndarray, trials: np.ndarray, hits: np.ndarray,
                  n: float) -> list:
    """Arrays of a summary row in the limit; all null where nothing is left, that is where all rows are separated.

    ``trials`` and ``hits`` are the sums per term. A term that is no level, or only part of a direction, is set aside
    with all rows, and has NaN for hits since no rows are its own.
    """
    beta, hessian, aside = in_the_limit(beta, hessian, gram)
    if not np.any(np.diag(hessian) > 0):
        return [None] * 5
    if not aside.any():
        return [beta, hessian @ beta, pack(hessian), None, None]
    own = (aside == 1) & (np.arange(layout.p) >= layout.p - sum(layout.widths))
    rows = np.where(own, trials, np.where(aside > 0, n, 0.0))
    return [beta, hessian @ beta, pack(hessian), rows, np.where(own, hits, np.where(aside > 0, np.nan, 0.0))]


def _fit_in_one_task(rows: DataFrame, spec: TermSpec, max_iter: int, tol: float) -> DataFrame:
    group = [*spec.keys, CHUNK]
    layout = _Layout(spec)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = [*key, *_fit_rows(layout, pdf, max_iter, tol)]
        return pd.DataFrame([row], columns=[*group, *_BODY_NAMES])

    return rows.groupBy(*group).applyInPandas(fit, _schema(rows, group, _BODY))


def fit_in_place(df: DataFrame, spec: TermSpec, rows_per_chunk: int = 1_000_000,
                 max_iter: int = 100, tol: float = 1e-12, fallback: bool = True) -> DataFrame:
    """Fit runs of ``rows_per_chunk`` rows as the scan delivers them: nothing is shuffled.

    Each task cuts its own input into chunks and holds at most two of them; the last run of a
    task that is shorter than half a chunk goes with the one before. Scan partitions with
    fewer rows than a chunk are read several to a task, so the result does not hang on the
    number of files. If a run has no optimum all rows are drawn into chunks and fitted by
    ``fit_chunks`` instead (unless ``fallback`` is off): none is left out. For rows stored in no particular order. Where
    files are sorted by a factor, use hashed chunk numbers.
    """
    if spec.keys:
        raise ValueError("rows of several models are mixed in a scan; give chunk numbers instead")
    total = df.count()
    parts = df.rdd.getNumPartitions()
    most = max(1, total // max(1, rows_per_chunk))
    df = df.coalesce(most) if parts > most else df
    rows = coded_rows(df.withColumn(CHUNK, F.lit(0).cast("bigint")), spec, compress=False)
    layout = _Layout(spec)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        for i, pdf in enumerate(_runs(batches, rows_per_chunk)):
            row = [base + i, *_fit_rows(layout, pdf, max_iter, tol)]
            yield pd.DataFrame([row], columns=[CHUNK, *_BODY_NAMES])

    found = _with_quality(rows.drop(CHUNK).mapInPandas(fit, f"{CHUNK} bigint, {_BODY}"), spec)
    if not fallback:
        return found
    found = settle(found)
    if found.filter("status <> 'ok'").isEmpty():
        return found
    drawn = stage(df.withColumn(CHUNK, F.floor(F.rand(1) * most).cast("bigint")), "drawn")
    return fit_chunks(drawn, spec, compress=False, max_iter=max_iter, tol=tol)


def _runs(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Cut a stream of batches into frames of ``size`` rows, the last between 0.5 and 1.5 of it."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        while rows >= 2 * size:
            whole = pd.concat(held, ignore_index=True)
            yield whole.iloc[:size]
            held, rows = [whole.iloc[size:]], rows - size
    if rows:
        whole = pd.concat(held, ignore_index=True)
        if rows >= 1.5 * size:
            yield whole.iloc[:size]
            whole = whole.iloc[size:]
        yield whole


_BODY_NAMES = ["n", "hits", "status", "iterations", "loglik", "theta", "v", "hess", "aside", "aside_hits"]


def sum_arrays(df: DataFrame, by: list[str], values: Column, into: str) -> DataFrame:
    """Element-wise sum of an array column: exploded, so Catalyst combines on the map side.

    What comes back is one array per group of the length of the model, never rows.
    """
    cells = df.select(*by, F.posexplode(values).alias("__i", "__x"))
    summed = cells.groupBy(*by, "__i").agg(F.sum("__x").alias("__x"))
    ordered = F.array_sort(F.collect_list(F.struct("__i", "__x")))
    return summed.groupBy(*by).agg(F.transform(ordered, lambda s: s["__x"]).alias(into))


# Rows of one block of a large chunk; a block is stored as one row of arrays.
BLOCK_ROWS = 16_384
# Sums a task holds before it passes them on.
_HELD_SUMS = 64


def _fit_in_pieces(rows: DataFrame, spec: TermSpec, max_iter: int, tol: float) -> DataFrame:
    """Newton over chunks cut in blocks; ``rows`` carries ``__rows``, the size of its chunk.

    Blocks are shuffled and written once. A Newton pass scans them with the current
    coefficients joined on, so only sums of the model's size move between tasks.
    """
    group = [*spec.keys, CHUNK]
    layout = _Layout(spec)
    p = layout.p
    blocks = _blocks(rows, layout, group)

    facts = sum_arrays(_block_sums(blocks, layout, group, _counting(layout)), group, F.col("sums"), "sums")
    n, hits = F.element_at("sums", 1), F.element_at("sums", 2)
    zeros = F.array_repeat(F.lit(0.0), p)
    nothing = F.lit(None).cast("array<double>")
    # The state row of a chunk: current beta, the step that led to it, the last good likelihood.
    state = settle(facts.select(
        *group, n.cast("bigint").alias("n"), hits.alias("hits"),
        F.when((hits == 0) | (hits == n), "one_class").otherwise("running").alias("status"),
        F.slice("sums", 3, 2 * p).alias("totals"), F.slice("sums", 3 + 2 * p, p * (p + 1) // 2).alias("gram"), F.lit(0).alias("iterations"), F.lit(0).alias("halvings"), F.lit(None).cast("double").alias("loglik"),
        zeros.alias("beta"), zeros.alias("step"), F.lit(False).alias("last"),
        *[nothing.alias(c) for c in _BODY_NAMES[5:]]))
    schema = state.schema

    def advance(batches):
        for pdf in batches:
            yield pd.DataFrame([_advance(r, layout, tol, max_iter) for r in pdf.to_dict("records")],
                               columns=schema.names)

    most = max(1, BROADCAST_ROWS * 8 // p)
    while True:
        running = state.filter(F.col("status") == "running").select(*group, "beta")
        if running.isEmpty():
            break
        at_beta = blocks.join(small_side(running, most), group)
        sums = sum_arrays(_block_sums(at_beta, layout, group, _newton_sums(layout)), group, F.col("sums"), "sums")
        state = settle(state.join(sums, group, "left").mapInPandas(advance, schema))

    return state.select(*group, *_BODY_NAMES)


def _blocks(rows: DataFrame, layout: _Layout, group: list[str]) -> DataFrame:
    """One row per block: the chunk and one array per column."""
    predictors = [*layout.continuous, *layout.codes]
    # Copies are added up first, so a hash of the predictors spreads what is left evenly.
    packed = rows.groupBy(*group, "__rows", *predictors).agg(
        F.sum("hits").alias("hits"), F.sum("trials").alias("trials"))
    blocks = F.ceil(F.col("__rows") / F.lit(BLOCK_ROWS))
    block = F.pmod(F.xxhash64(*predictors), blocks) if predictors else F.lit(0)
    columns = [*predictors, "hits", "trials"]
    listed = packed.groupBy(*group, block.alias("__block")).agg(
        F.collect_list(F.struct(*columns)).alias("__r"))
    return settle(listed.select(*group, *[F.col("__r").getField(c).alias(c) for c in columns]))


def _block_sums(blocks: DataFrame, layout: _Layout, group: list[str], terms) -> DataFrame:
    """Sums of ``terms`` over the blocks of each task, one row per chunk and task."""
    columns = [*group, "sums"]

    def add_up(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for row in pdf.to_dict("records"):
                key = tuple(row[g] for g in group)
                new = terms(row)
                held[key] = held[key] + new if key in held else new
                if len(held) > _HELD_SUMS:
                    yield pd.DataFrame([[*k, v] for k, v in held.items()], columns=columns)
                    held.clear()
        if held:
            yield pd.DataFrame([[*k, v] for k, v in held.items()], columns=columns)

    return blocks.mapInPandas(add_up, _schema(blocks, group, "sums array<double>"))


def _counting(layout: _Layout):
    """Rows and hits of a block, both by term, and its packed Gram matrix."""

    def terms(row: dict) -> np.ndarray:
        trials, hits = np.asarray(row["trials"], float), np.asarray(row["hits"], float)
        design = layout.block_design(row)
        return np.concatenate([[trials.sum(), hits.sum()], design.left(trials), design.left(hits), pack(design.gram(trials))])

    return terms


def _newton_sums(layout: _Layout):
    """Log-likelihood, gradient and packed Hessian of a block."""

    def terms(row: dict) -> np.ndarray:
        ll, g, h = logistic_sums(
            layout.block_design(row), np.asarray(row["beta"], float),
            np.asarray(row["hits"], float), np.asarray(row["trials"], float))
        return np.concatenate([[ll], g, pack(h)])

    return terms


def _advance(row: dict, layout: _Layout, tol: float, max_iter: int) -> dict:
    """One Newton move of a chunk from the sums at its current beta; stops as ``newton_fit`` does."""
    sums = row.pop("sums")
    if sums is None or row["status"] != "running":
        return row
    p = layout.p
    sums = np.asarray(sums, float)
    loglik, gradient, hessian = sums[0], sums[1: 1 + p], unpack(sums[1 + p:], p)
    beta, step = np.asarray(row["beta"], float), np.asarray(row["step"], float)
    before = row["loglik"]
    first = before is None or np.isnan(before)
    if not first and not loglik >= before - 1e-10 * (1.0 + abs(before)):
        half = step / 2.0
        halvings = int(row["halvings"]) + 1
        status = "not_converged" if halvings >= MAX_HALVINGS else "running"
        return {**row, "beta": beta - half, "step": half, "halvings": halvings, "status": status}
    row.update(loglik=loglik, iterations=int(row["iterations"]) + (0 if first else 1), halvings=0)
    if row["last"] and row["iterations"] >= CALM_STEPS:
        totals = np.asarray(row["totals"], float)
        found = _limit_arrays(layout, beta, hessian, unpack(np.asarray(row["gram"], float), p), totals[:p], totals[p:], row["n"])
        return {**row, "status": "not_converged" if found[0] is None else "ok", **dict(zip(_BODY_NAMES[5:], found, strict=True))}
    if row["last"]:
        return {**row, "status": "ok", "theta": beta, "v": hessian @ beta, "hess": pack(hessian)}
    if row["iterations"] >= max_iter:
        return {**row, "status": "not_converged"}
    step = newton_step(gradient, hessian)
    return {**row, "beta": beta + step, "step": step, "last": small_step(step, beta, tol)}
