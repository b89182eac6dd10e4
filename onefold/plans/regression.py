"""The main job: prepare, describe, select levels, fit chunks, combine, shrink, evaluate, save."""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.operators import chunks as chunking
from onefold.operators import levels as lv
from onefold.operators.chunkfit import fit_chunks, fit_in_place, one_class_terms
from onefold.operators.combine import RETURNED, append_summaries, coefficients, combine
from onefold.operators.evaluate import loglik
from onefold.operators.prepare import add_codes, binarise, project, unseen_rows
from onefold.operators.shrink import estimates, shrink_path
from onefold.operators.stats import describe, merge_stats
from onefold.session import settle, small_side, stage
from onefold.sources import store
from onefold.spec import MAX_TERMS, TermSpec

# Column of the uniform draw that stands in for a row key.
DRAW = "__draw"
# Most tasks that planned chunks are dealt over.
MAX_TASKS = 20_000
METHODS = ("wlse", "one_shot", "aic", "bic")
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Plan:
    """What to fit. ``keep_top`` maps each factor to the cumulative share of levels to keep.

    ``in_place`` cuts chunks from the scan and shuffles no row; otherwise rows are hashed into
    chunks by ``row_key``. Without a row key every row draws its chunk once, and the draw is stored
    with the rows: equal rows then lie in different chunks. ``unseen`` says what becomes of rows
    with a level that a reused term list does not have: ``leave_out`` (counted in ``Fit.unseen``)
    or ``error``. A term list with ``OTHERS`` takes them there.
    """

    response: str
    continuous: Sequence[str] = ()
    keep_top: Mapping[str, float] = field(default_factory=dict)
    min_share: float | None = None
    baseline: str | Mapping[str, str] = "none"
    intercept: bool = True
    keys: Sequence[str] = ()
    row_key: Sequence[str] = ()
    rows_per_chunk: int = 1_000_000
    kind: str = "lar"
    threshold: float = 0.0
    standardise: bool = True
    in_place: bool = False
    unseen: str = "leave_out"
    max_terms: int = MAX_TERMS


@dataclass
class Fit:
    """A fitted model. ``summary`` holds all chunks, also those of a model that was extended.

    ``rows`` are the rows read in this run, and ``evaluation`` scores these. ``unseen`` counts
    their rows left out per factor and level. ``held`` are the prepared rows, of this run and of
    those it extends, of models without an optimum and of levels of one class: an extension fits them again
    together with its own where that gives them an estimate.
    """

    spec: TermSpec
    rows: DataFrame
    levels: DataFrame | None
    stats: DataFrame | None
    summary: DataFrame
    combined: DataFrame
    path: DataFrame
    betas: DataFrame
    seconds: dict[str, float]
    unseen: DataFrame | None = None
    held: DataFrame | None = None
    # For an extension: the folder and version it was read from, and the summaries to be added to that
    # version's; None if these have changed otherwise.
    base: tuple[str, int] | None = None
    added: DataFrame | None = None

    def close(self) -> None:
        """Release the prepared rows."""
        self.rows.unpersist()

    def __enter__(self) -> Fit:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def coefficients(self) -> DataFrame:
        return coefficients(self.betas, self.spec, {m: m for m in METHODS})

    def evaluation(self) -> DataFrame:
        """Log-likelihoods over the rows of this run; after an extension these are the new rows."""
        return loglik(self.rows, self.spec, self.betas, METHODS)

    def run(self) -> DataFrame:
        seconds = [F.lit(round(v, 3)).alias(f"seconds_{k}") for k, v in self.seconds.items()]
        return store.run_row(self.combined, self.spec).select("*", *seconds)

    def save(self, path: str, slices: Sequence[str] = ()) -> None:
        """Save as the next version in the folder; ``slices`` name the data of this run for the ledger.

        An extension saved over the model it extends adds its summaries; saved elsewhere, all are written.
        """
        onward = self.base is not None and self.base[0] == path
        grown = ["summary"] if onward and self.added is not None else []
        tables = {"summary": self.added if grown else self.summary, "combined": self.combined, "path": self.path,
                  "coef": self.coefficients(), "eval": self.evaluation(), "run": self.run()}
        for name in ("levels", "stats", "unseen", "held"):
            if getattr(self, name) is not None:
                tables[name] = getattr(self, name)
        store.save_model(path, self.spec, base=self.base[1] if onward else None, grown=grown, slices=slices, **tables)

    def report(self) -> None:
        """Print run metrics, log-likelihoods, rows left out and all coefficients."""
        self.run().show(truncate=False)
        self.evaluation().show(truncate=False)
        if self.unseen is not None and not self.unseen.isEmpty():
            self.unseen.orderBy("factor", "level").show(self.unseen.count(), truncate=False)
        table = self.coefficients().orderBy(*self.spec.keys, "method", "term")
        table.show(table.count(), truncate=False)


def _used(df: DataFrame, plan: Plan) -> list[str]:
    used = [plan.response, *plan.continuous, *plan.keep_top, *plan.keys, *plan.row_key]
    used += [chunking.CHUNK] if chunking.CHUNK in df.columns else []
    return list(dict.fromkeys(used))


def prepare(df: DataFrame, plan: Plan) -> DataFrame:
    """Used columns only, no nulls, 0/1 response."""
    return binarise(project(df, _used(df, plan)), plan.response, plan.threshold)


def input_counts(df: DataFrame, plan: Plan) -> DataFrame:
    """One row: rows read, rows used and nulls of every used column, in one pass that reads only these columns."""
    used = _used(df, plan)
    whole = F.lit(True)
    for c in used:
        whole = whole & F.col(f"`{c}`").isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(whole).alias("rows_used"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{c}") for c in used])


def learn_spec(rows: DataFrame, plan: Plan) -> tuple[TermSpec, DataFrame | None, DataFrame | None]:
    """Levels and statistics of prepared rows, and the term list they give."""
    factors = list(plan.keep_top)
    levels = stats = None
    if factors:
        picked = lv.select_levels(lv.level_counts(rows, factors), plan.keep_top, plan.min_share)
        levels = settle(lv.term_levels(picked))
        spec = TermSpec.from_levels(levels, plan.response, plan.continuous, factors,
                                    plan.baseline, plan.intercept, plan.keys, plan.max_terms)
    else:
        spec = TermSpec(plan.response, tuple(plan.continuous), (), plan.intercept, tuple(plan.keys))
    if plan.continuous and plan.standardise:
        stats = settle(describe(rows, plan.continuous))
        spec = spec.with_scales(stats)
    return spec, levels, stats


def assign_chunks(rows: DataFrame, plan: Plan, n: int | None = None) -> DataFrame:
    """Chunk numbers, unless the rows have them: per model as many as its row count asks for; ``n`` is that of all rows if known."""
    if chunking.CHUNK in rows.columns:
        return rows
    if plan.keys:
        sizes = chunking.chunk_plan(rows, plan.rows_per_chunk, plan.keys)
        if plan.row_key:
            return chunking.chunk_by_plan(rows, sizes, list(plan.row_key), plan.keys)
        sizes = small_side(settle(sizes.select(*plan.keys, "chunks")))
        chunk = F.floor(F.col(DRAW) * F.col("chunks")).cast("bigint")
        return rows.join(sizes, list(plan.keys)).withColumn(chunking.CHUNK, chunk).drop("chunks")
    k = chunking.chunk_count(rows.count() if n is None else n, plan.rows_per_chunk)
    if plan.row_key:
        return chunking.chunk_by_hash(rows, list(plan.row_key), k)
    return rows.withColumn(chunking.CHUNK, F.floor(F.col(DRAW) * k).cast("bigint"))


def _fit_rows(rows: DataFrame, plan: Plan, spec: TermSpec, n: int | None = None) -> DataFrame:
    """Summaries of prepared rows, ``n`` of them if that is known."""
    if plan.in_place:
        return settle(fit_in_place(rows, spec, plan.rows_per_chunk))
    # Drawn and hashed chunk numbers are bounded by the plan; numbers that rows bring are counted.
    planned = chunking.CHUNK not in rows.columns
    if planned and n is None:
        n = rows.count()
    chunked = assign_chunks(rows, plan, n)
    most = max(1, n // max(1, plan.rows_per_chunk)) if planned else None
    return settle(fit_chunks(chunked, spec, tasks=min(most, MAX_TASKS) if most else None))


def _of_models(df: DataFrame, models: DataFrame, keys: Sequence[str], inside: bool = True) -> DataFrame:
    """Rows of the models listed, or of the others; without keys there is one model."""
    if not keys:
        return df if models.isEmpty() != inside else df.limit(0)
    return df.join(small_side(models), list(keys), "left_semi" if inside else "left_anti").select(*df.columns)


def _rows_with(rows: DataFrame, spec: TermSpec, cells: DataFrame) -> DataFrame:
    """Rows that have one of the levels listed (``keys, term``) for their model."""
    out, hit = add_codes(rows, spec), F.lit(False)
    for f in spec.factors:
        at, flag = spec.offset(f), f"__in_{f.name}"
        own = cells.filter(F.col("term").between(at, at + len(f.slots) - 1)).select(
            *spec.keys, (F.col("term") - at).cast("int").alias(f"code_{f.name}"), F.lit(True).alias(flag))
        out = out.join(small_side(settle(own)), [*spec.keys, f"code_{f.name}"], "left")
        hit = hit | F.coalesce(F.col(flag), F.lit(False))
    return out.filter(hit).select(*rows.columns)


def _returned(rows: DataFrame, spec: TermSpec, aside: DataFrame, like: DataFrame) -> DataFrame:
    """Entries, one per model, that take these rows out of the counts of the stored summaries."""
    p, keys = spec.p, list(spec.keys)
    codes = add_codes(rows, spec)
    terms = F.filter(F.array(*[F.when(F.col(f"code_{f.name}") < len(f.slots), F.col(f"code_{f.name}") + spec.offset(f)) for f in spec.factors]),
                     lambda t: t.isNotNull())
    hits = F.col(spec.response).cast("double")
    cells = codes.select(*keys, F.explode(terms).alias("term"), hits.alias("y")).join(
        small_side(settle(aside.select(*keys, "term"))), [*keys, "term"]).groupBy(*keys, "term").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    pairs = cells.groupBy(*keys, F.lit(1).alias("__m")).agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("n", "y")))).alias("__c"))
    whole = rows.groupBy(*keys, F.lit(1).alias("__m")).agg(F.count("*").alias("__n"), F.sum(hits).alias("__y"))
    at = F.sequence(F.lit(0), F.lit(p - 1))

    def taken(field: str):
        return F.transform(at, lambda i: -F.coalesce(F.col("__c")[i][field], F.lit(0)).cast("double"))

    zeros = F.array_repeat(F.lit(0.0), p)
    made = {"partition_id": F.lit(-1), "n": -F.col("__n"), "hits": -F.col("__y"), "status": F.lit(RETURNED), "iterations": F.lit(0), "loglik": F.lit(0.0),
            "theta": zeros, "v": zeros, "hess": F.array_repeat(F.lit(0.0), p * (p + 1) // 2), "aside": taken("n"), "aside_hits": taken("y"),
            "has_nan": F.lit(False)}
    both = whole.join(pairs, [*keys, "__m"])
    return both.select(*[(made[f.name] if f.name in made else F.col(f.name)).cast(f.dataType).alias(f.name) for f in like.schema])


def _fit_with_held(rows: DataFrame, plan: Plan, spec: TermSpec, stored: DataFrame | None,
                   held: DataFrame | None, n: int | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame | None]:
    """Summaries of the rows, the stored ones that still hold, the rows that a later extension may need, and the new summaries.

    The last is None where stored summaries were dropped, so that adding to them is not enough.

    Held are all rows of a model without an optimum, and in other models the rows of levels that are
    of one class throughout, which are set aside and say nothing of their level yet. Rows of the first
    kind are fitted again with the new ones of their model; those of the second only when the new
    rows have the other class of their level, so that a held row is read again at most once for each of its levels.
    """
    keys = list(spec.keys)
    models = [F.col(k) for k in keys] or [F.lit(1).alias("one")]
    summary = _fit_rows(rows, plan, spec, n)
    plain = rows.drop(DRAW)
    fresh, entries, dropped = plain, None, False
    if held is not None and stored is not None and not held.isEmpty():
        held = held.select(*plain.columns)
        known = settle(one_class_terms(stored, spec, everywhere=False))
        seen = settle(_seen_terms(summary, spec))
        # Worth another fit: the new rows have the class that the stored ones of the level lack.
        useful = known.join(seen.withColumnsRenamed({"n": "__n", "hits": "__hits"}), [*keys, "term"]).filter(
            "alive OR (hits > 0) <> (__hits > 0)").select(*keys, "term")
        useful = settle(useful)
        stuck = settle(stored.filter(~F.col("status").isin("ok", RETURNED)).select(*models).distinct())
        waiting = settle(stuck.unionByName(useful.select(*models)).distinct())
        if not waiting.isEmpty():
            of_stuck = _of_models(held, stuck, keys)
            back = settle(of_stuck if useful.isEmpty() else of_stuck.unionByName(_rows_with(_of_models(held, stuck, keys, inside=False), spec, useful)))
            both = _of_models(plain, waiting, keys).unionByName(back)
            if DRAW in rows.columns:
                both = stage(both.withColumn(DRAW, F.rand(20240229)), "rows")
            refit = _fit_rows(both, plan, spec)
            failed = settle(refit.filter("status <> 'ok'").select(*models).distinct())
            # Without keys, one model: settled if nothing failed.
            settled = settle(waiting.exceptAll(failed))
            refit = _of_models(refit, settled, keys)
            summary = settle(_of_models(summary, settled, keys, inside=False).unionByName(refit))
            taken = _of_models(_of_models(back, stuck, keys, inside=False), settled, keys)
            entries = _returned(taken, spec, known, stored)
            good = stored.filter(F.col("status").isin("ok", RETURNED))
            rest = stored.filter(~F.col("status").isin("ok", RETURNED))
            entries = settle(entries)
            dropped = not stuck.isEmpty()
            stored = settle(good.unionByName(_of_models(rest, settled, keys, inside=False)).unionByName(entries))
            done = _of_models(back, settled, keys)
            fresh = plain.unionByName(done)
            held = settle(held.exceptAll(done))
    else:
        held = None
    bad = settle(summary.filter("status <> 'ok'").select(*models).distinct())
    left = _of_models(plain, bad, keys).select(*plain.columns)
    lone = settle(one_class_terms(summary, spec))
    if not lone.isEmpty():
        left = left.unionByName(_rows_with(_of_models(fresh, bad, keys, inside=False), spec, lone).select(*plain.columns))
    added = None if dropped else summary if entries is None else summary.unionByName(entries)
    return summary, stored, settle(left if held is None else held.unionByName(left)), added


def _seen_terms(summary: DataFrame, spec: TermSpec) -> DataFrame:
    """``keys, term, n, hits, alive``: levels with rows in the summaries, and whether a chunk has both classes."""
    lone = one_class_terms(summary, spec).withColumn("alive", F.lit(False))
    p = spec.p
    diagonal = F.array(*[F.lit(i * p - i * (i - 1) // 2) for i in range(p)])
    cells = summary.filter("theta IS NOT NULL").select(*spec.keys, F.posexplode(F.transform(diagonal, lambda i: F.get("hess", i))).alias("term", "h"))
    living = cells.groupBy(*spec.keys, "term").agg(F.max("h").alias("h")).filter("h > 0")
    zero = F.lit(0.0)
    return lone.unionByName(living.select(*spec.keys, "term", zero.alias("n"), zero.alias("hits"), F.lit(True).alias("alive")))


def extend(df: DataFrame, plan: Plan, folder: str, slices: Sequence[str] = ()) -> Fit | None:
    """Extend a stored model by new rows; its levels and its scales are kept, its statistics are merged with those of the rows.

    ``slices`` name the data that ``df`` holds. If the ledger of the model has them all, they were added by an
    earlier run: nothing is read and None is returned. Save the result with the same ``slices``.
    """
    spark = df.sparkSession
    known = store.known_slices(spark, folder, slices)
    if known and known == set(slices):
        return None
    if known:
        raise store.Conflict(f"already in the model: {sorted(known)[:5]}")
    version = store.newest(spark, folder)["version"]
    spec = store.load_spec(spark, folder)
    held = store.load_table(spark, folder, "held") if store.has_table(spark, folder, "held") else None
    out = fit(df, plan, spec=spec, stored=store.load_table(spark, folder, "summary"), held=held)
    out.base = (folder, version)
    if store.has_table(spark, folder, "levels"):
        out.levels = store.load_table(spark, folder, "levels")
    if store.has_table(spark, folder, "stats"):
        out.stats = settle(merge_stats(store.load_table(spark, folder, "stats"), describe(out.rows, list(spec.continuous))))
    return out


def fit(df: DataFrame, plan: Plan, spec: TermSpec | None = None, stored: DataFrame | None = None,
        persist: StorageLevel | None = StorageLevel.DISK_ONLY, held: DataFrame | None = None) -> Fit:
    """Fit one model, or one per model key.

    Pass ``spec`` to reuse the terms of an earlier run, and ``stored`` (its summary table) to
    extend it: only the new rows are read, and those ``held`` back for want of an optimum. Prepared rows are narrow and used for counting,
    fitting and evaluation, so they are persisted once.
    """
    seconds: dict[str, float] = {}

    def timed(name: str, start: float) -> None:
        seconds[name] = time.perf_counter() - start
        log.info("%s: %.1f s", name, seconds[name])

    t = time.perf_counter()
    rows, n = prepare(df, plan), None
    if not (plan.row_key or plan.in_place or chunking.CHUNK in rows.columns):
        # Written, so that the draw stays what it is when an executor is lost; its rows are then counted from the file footers.
        rows = stage(rows.withColumn(DRAW, F.rand(20240229)), "rows")
        n = rows.count()
    elif persist is not None:
        rows = rows.persist(persist)
    levels = stats = unseen = None
    if spec is not None and spec.factors:
        unseen = settle(unseen_rows(rows, spec))
        if plan.unseen == "error" and not unseen.isEmpty():
            raise ValueError(f"levels without a term: {[tuple(r) for r in unseen.take(5)]}")
    if spec is None:
        spec, levels, stats = learn_spec(rows, plan)
    timed("prepare", t)
    t = time.perf_counter()
    summary, stored, held, added = _fit_with_held(rows, plan, spec, stored, held, n)
    timed("fit", t)
    t = time.perf_counter()
    if stored is not None:
        summary = settle(append_summaries(stored, summary))
    combined = settle(combine(summary, spec))
    timed("combine", t)
    t = time.perf_counter()
    path = settle(shrink_path(combined, spec, plan.kind))
    betas = settle(estimates(combined, path, spec))
    timed("shrink", t)
    return Fit(spec, rows, levels, stats, summary, combined, path, betas, seconds, unseen, held, added=added)
