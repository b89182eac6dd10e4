"""Registered queries: chunk fits, combining, shrinkage, evaluation and baselines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from onefold.catalog.tables import CELLS, PATH, SHIP, factor_spec, rnd, shipments, table
from onefold.operators.chunkfit import fit_chunks, fit_in_place
from onefold.operators.combine import (
    append_summaries, coefficients, coefficients_wide, combine, summary_matrix, summary_terms,
)
from onefold.operators.compare import compare, cut
from onefold.operators.evaluate import constants, loglik, predict, score_check
from onefold.operators.prepare import standardise_columns, unseen_rows
from onefold.operators.shrink import choose, estimates, path_terms, rank_steps, shrink_path
from onefold.operators.stats import describe
from onefold.plans import ml
from onefold.plans.regression import METHODS, Plan, extend, fit
from onefold.plans.sgd import fit_sgd
from onefold.session import scratch_path, settle, stage
from onefold.sources import store
from onefold.spec import OTHERS, Factor, TermSpec
from onefold.streaming.arrivals import stream_model

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def cell_model(spark, d):
    """Rows and term list of the cell-means model: one factor of ten cells, no intercept."""
    rows = stage(shipments(spark, d).select("partition_id", "cell", "late", "o_orderpriority", "l_returnflag"), "cells")
    return rows, factor_spec(rows, "late", ["cell"])


def _cells(spark, d, **kw):
    rows, spec = cell_model(spark, d)
    return rows, spec, fit_chunks(rows, spec, **kw)


@query("chunk_fit_cells", f"""WITH {CELLS} SELECT partition_id, CAST(sum(n) OVER (PARTITION BY partition_id) AS BIGINT) AS n,
  'cell_' || cell AS term, round(theta, 6) + 0.0 AS theta, round(h * theta, 6) + 0.0 AS v, round(h, 6) AS h FROM fits""")
def _(spark, d):
    _, spec, summary = _cells(spark, d)
    return summary_terms(summary, spec).withColumns({c: rnd(c) for c in ("theta", "v", "h")})


@query("chunk_summary_matrix", f"""WITH {CELLS}, r AS (SELECT partition_id, theta, h,
  CAST(row_number() OVER (PARTITION BY partition_id ORDER BY cell) - 1 AS INTEGER) AS par_id FROM fits)
SELECT partition_id, par_id, round(theta, 8) + 0.0 AS coef, round(h * theta, 6) + 0.0 AS moment, """ + ", ".join(
    f"CASE WHEN par_id = {i} THEN round(h, 6) ELSE 0.0 END AS c{i}" for i in range(10)) + " FROM r")
def _(spark, d):
    _, spec, summary = _cells(spark, d)
    out = summary_matrix(summary, spec)
    return out.select("partition_id", "par_id", rnd("coef", 8).alias("coef"), rnd("moment").alias("moment"), *[
        rnd(F.col(f"`{t}`")).alias(f"c{i}") for i, t in enumerate(spec.terms)])


_WLSE = f"WITH {CELLS} SELECT term, round(b, 8) + 0.0 AS wlse, CAST((SELECT sum(n) FROM wl) AS BIGINT) AS n_used FROM wl"


def _wlse(combined, spec, *more):
    terms = F.array(*[F.lit(t) for t in spec.terms])
    cells = combined.select("n_used", *more, F.posexplode("wlse").alias("i", "b"))
    return cells.select(F.element_at(terms, F.col("i") + 1).alias("term"), rnd("b", 8).alias("wlse"), "n_used", *more)


@query("combine_wlse", _WLSE)
def combine_wlse(spark, d):
    _, spec, summary = _cells(spark, d)
    return _wlse(combine(summary, spec), spec)


@query("combine_oneshot", f"WITH {CELLS} SELECT term, round(one_shot, 8) + 0.0 AS one_shot FROM wl")
def _(spark, d):
    _, spec, summary = _cells(spark, d)
    long = coefficients(combine(summary, spec), spec, {"one_shot": "one_shot"})
    return long.select("term", rnd("estimate", 8).alias("one_shot"))


@query("combine_incremental", _WLSE)
def _(spark, d):
    # The first half of the chunks is fitted and stored, the rest appended, then one combine.
    rows, spec = cell_model(spark, d)
    early = settle(fit_chunks(rows.filter(F.col("partition_id") < 2), spec))
    later = fit_chunks(rows.filter(F.col("partition_id") >= 2), spec)
    return _wlse(combine(append_summaries(early, later), spec), spec)


@query("combine_split_chunks", _WLSE)
def _(spark, d):
    # Every chunk counts as too large for a task here, so all are fitted in pieces.
    _, spec, summary = _cells(spark, d, rows_per_task=3)
    return _wlse(combine(summary, spec), spec)


_ABSENT = CELLS.replace("FROM ship GROUP BY partition_id, cell", """FROM ship
  WHERE NOT (partition_id = 0 AND cell LIKE '1-URGENT%' OR partition_id = 1 AND cell = '5-LOW|F') GROUP BY partition_id, cell""")


@query("combine_absent_level", f"""WITH {_ABSENT} SELECT term, round(b, 8) + 0.0 AS wlse, round(one_shot, 8) + 0.0 AS one_shot,
  CAST((SELECT sum(n) FROM wl) AS BIGINT) AS n_total, CAST((SELECT sum(n) FROM wl) AS BIGINT) AS n_used FROM wl""")
def _(spark, d):
    # Two chunks lack cells that others have; no chunk and no row is lost.
    rows, spec = cell_model(spark, d)
    gone = ((F.col("partition_id") == 0) & F.col("cell").startswith("1-URGENT")) | (
        (F.col("partition_id") == 1) & (F.col("cell") == "5-LOW|F"))
    combined = settle(combine(fit_chunks(rows.filter(~gone), spec), spec))
    wide = coefficients_wide(coefficients(combined, spec, {"wlse": "wlse", "one_shot": "one_shot"}), spec, ["wlse", "one_shot"])
    totals = combined.select("n_total", "n_used").first()
    return wide.select("term", rnd("wlse", 8).alias("wlse"), rnd("one_shot", 8).alias("one_shot"),
                       *[F.lit(totals[c]).cast("bigint").alias(c) for c in ("n_total", "n_used")])


_ONE_CLASS = CELLS.replace("FROM ship GROUP BY partition_id, cell", "FROM ship WHERE NOT (cell = '5-LOW|F' AND late = 1) GROUP BY partition_id, cell")


@query("chunk_fit_separated", f"""WITH {_ONE_CLASS.replace("FROM counts)", "FROM counts WHERE y > 0)")}, t AS (SELECT sum(n) AS n FROM counts)
SELECT term, round(wl.b, 8) + 0.0 AS wlse, true AS estimable, CAST(0 AS DOUBLE) AS aside, CAST(t.n AS BIGINT) AS n_used, CAST(t.n AS BIGINT) AS n_total
FROM wl, t UNION ALL
SELECT 'cell_5-LOW|F', 0.0, false, sum(counts.n), CAST(any_value(t.n) AS BIGINT), CAST(any_value(t.n) AS BIGINT) FROM counts, t WHERE y = 0""")
def _(spark, d):
    # One level has rows of one class only. All other terms are as without it, and every row counts as used.
    rows, spec = cell_model(spark, d)
    combined = combine(fit_chunks(rows.filter("NOT (cell = '5-LOW|F' AND late = 1)"), spec), spec)
    terms = F.array(*[F.lit(t) for t in spec.terms])
    cells = combined.select("n_used", "n_total", F.inline(F.arrays_zip(terms.alias("term"), "wlse", "estimable", "aside")))
    return cells.select("term", rnd("wlse", 8).alias("wlse"), "estimable", "aside", "n_used", "n_total")


_MOVED = CELLS.replace("FROM ship GROUP BY partition_id, cell", """FROM (SELECT late, cell, CASE WHEN cell = '5-LOW|F' AND partition_id = 2 THEN 0
    WHEN cell = '1-URGENT|O' AND partition_id = 1 THEN 0 WHEN cell = '1-URGENT|O' AND partition_id = 2 THEN 3 ELSE partition_id END AS partition_id
  FROM ship WHERE NOT (partition_id = 2 AND cell = '5-LOW|F' AND late = 1)
    AND NOT (partition_id IN (1, 2) AND cell = '1-URGENT|O' AND late = 0)) GROUP BY partition_id, cell""")


@query("chunk_fit_moved", f"""WITH {_MOVED} SELECT term, round(b, 8) + 0.0 AS wlse, round(one_shot, 8) + 0.0 AS one_shot,
  CAST((SELECT sum(n) FROM wl) AS BIGINT) AS n_used FROM wl""")
def _(spark, d):
    # Levels of one class in some chunks: their rows go, in turn, to the chunks where they have both.
    rows, spec = cell_model(spark, d)
    gone = (F.col("partition_id") == 2) & (F.col("cell") == "5-LOW|F") & (F.col("late") == 1)
    also = F.col("partition_id").isin(1, 2) & (F.col("cell") == "1-URGENT|O") & (F.col("late") == 0)
    combined = settle(combine(fit_chunks(rows.filter(~gone & ~also), spec), spec))
    wide = coefficients_wide(coefficients(combined, spec, {"wlse": "wlse", "one_shot": "one_shot"}), spec, ["wlse", "one_shot"])
    return wide.select("term", rnd("wlse", 8).alias("wlse"), rnd("one_shot", 8).alias("one_shot"),
                       F.lit(combined.first()["n_used"]).cast("bigint").alias("n_used"))


def segment_model(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    rows = shipments(spark, d).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = stage(rows.select("c_mktsegment", "partition_id", "o_orderpriority", "late"), "segments")
    return rows, factor_spec(rows, "late", ["o_orderpriority"], keys=["c_mktsegment"])


_SEGMENT = f"""{SHIP}, seg AS (SELECT c_mktsegment, partition_id, o_orderpriority, late FROM ship
  JOIN customer ON o_custkey = c_custkey), counts AS (
  SELECT c_mktsegment, partition_id, o_orderpriority, CAST(count(*) AS DOUBLE) AS n, CAST(sum(late) AS DOUBLE) AS y
  FROM seg GROUP BY ALL), fits AS (SELECT *, ln(y / (n - y)) AS theta, y * (n - y) / n AS h FROM counts), wl AS (
  SELECT c_mktsegment, 'o_orderpriority_' || o_orderpriority AS term, sum(h * theta) / sum(h) AS wlse,
         avg(theta) AS one_shot FROM fits GROUP BY 1, 2)"""


@query("combine_by_segment", f"""WITH {_SEGMENT} SELECT c_mktsegment, term, round(wlse, 8) + 0.0 AS wlse,
  round(one_shot, 8) + 0.0 AS one_shot FROM wl""")
def _(spark, d):
    rows, spec = segment_model(spark, d)
    combined = combine(fit_chunks(rows, spec), spec)
    wide = coefficients_wide(coefficients(combined, spec, {"wlse": "wlse", "one_shot": "one_shot"}), spec,
                             ["wlse", "one_shot"])
    return wide.select("c_mktsegment", "term", rnd("wlse", 8).alias("wlse"), rnd("one_shot", 8).alias("one_shot"))


_SEGMENT_ABSENT = _SEGMENT.replace("JOIN customer ON o_custkey = c_custkey)",
                                   "JOIN customer ON o_custkey = c_custkey WHERE NOT (c_mktsegment = 'BUILDING' AND o_orderpriority = '5-LOW'))")


@query("combine_by_segment_absent", f"""WITH {_SEGMENT_ABSENT}, t AS (SELECT c_mktsegment, sum(n) AS n FROM counts GROUP BY 1),
  terms AS (SELECT DISTINCT term FROM wl)
SELECT c_mktsegment, term, round(coalesce(wlse, 0.0), 8) + 0.0 AS wlse, wlse IS NOT NULL AS estimable, CAST(n AS BIGINT) AS n_used
FROM t CROSS JOIN terms LEFT JOIN wl USING (c_mktsegment, term)""")
def _(spark, d):
    # One model lacks a level of the shared term list: it is fitted without that term.
    rows, spec = segment_model(spark, d)
    rows = rows.filter(~((F.col("c_mktsegment") == "BUILDING") & (F.col("o_orderpriority") == "5-LOW")))
    terms = F.array(*[F.lit(t) for t in spec.terms])
    cells = combine(fit_chunks(rows, spec), spec).select(
        "c_mktsegment", "n_used", F.inline(F.arrays_zip(terms.alias("term"), "wlse", "estimable")))
    return cells.select("c_mktsegment", "term", rnd("wlse", 8).alias("wlse"), "estimable", "n_used")


@query("loglik_by_segment", f"""WITH {_SEGMENT}, p AS (SELECT c_mktsegment, term, 1 / (1 + exp(-wlse)) AS pw,
  1 / (1 + exp(-one_shot)) AS po FROM wl)
SELECT c_mktsegment, count(*) AS n, round(sum(late * ln(pw) + (1 - late) * ln(1 - pw)), 4) AS loglik_wlse,
  round(sum(late * ln(po) + (1 - late) * ln(1 - po)), 4) AS loglik_one_shot
FROM seg JOIN p USING (c_mktsegment) WHERE p.term = 'o_orderpriority_' || o_orderpriority GROUP BY 1""")
def _(spark, d):
    rows, spec = segment_model(spark, d)
    combined = combine(fit_chunks(rows, spec), spec)
    out = loglik(rows, spec, combined, ["wlse", "one_shot"])
    return out.withColumns({c: rnd(c, 4) for c in ("loglik_wlse", "loglik_one_shot")})


@query("run_metrics", f"""WITH {CELLS} SELECT CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(n) AS BIGINT) AS n_used,
  CAST(count(DISTINCT partition_id) AS BIGINT) AS chunks_total, CAST(count(DISTINCT partition_id) AS BIGINT) AS chunks_used,
  round(sum(n) / count(DISTINCT partition_id), 6) AS rows_per_chunk, CAST(count(DISTINCT cell) AS BIGINT) AS terms FROM fits""")
def _(spark, d):
    _, spec, summary = _cells(spark, d)
    return store.run_row(combine(summary, spec), spec).withColumn("rows_per_chunk", rnd("rows_per_chunk"))


# Shrinkage -------------------------------------------------------------------------------

def _path(spark, d, kind="lar"):
    rows, spec, summary = _cells(spark, d)
    combined = settle(combine(summary, spec))
    return rows, spec, combined, shrink_path(combined, spec, kind)


_PATH_SQL = f"""WITH {PATH} SELECT step, term, round(beta, 8) + 0.0 AS beta, round(rss, 6) + 0.0 AS rss, dof,
  round(aic, 6) + 0.0 AS aic, round(bic, 6) + 0.0 AS bic FROM steps JOIN scored USING (step)"""


def _rounded_path(path, spec):
    out = path_terms(path, spec)
    return out.select("step", "term", rnd("beta", 8).alias("beta"), rnd("rss").alias("rss"), "dof",
                      rnd("aic").alias("aic"), rnd("bic").alias("bic"))


@query("shrink_path", _PATH_SQL)
def _(spark, d):
    _, spec, _, path = _path(spark, d)
    return _rounded_path(path, spec)


@query("shrink_path_lasso", _PATH_SQL)
def _(spark, d):
    _, spec, _, path = _path(spark, d, "lasso")
    return _rounded_path(path, spec)


@query("shrink_choice", f"""WITH {PATH}, best AS (
  SELECT 'aic' AS criterion, (SELECT step FROM scored ORDER BY aic, step LIMIT 1) AS step UNION ALL
  SELECT 'bic', (SELECT step FROM scored ORDER BY bic, step LIMIT 1))
SELECT criterion, step, term, round(beta, 8) + 0.0 AS beta, dof,
  round(CASE WHEN criterion = 'aic' THEN aic ELSE bic END, 6) + 0.0 AS score
FROM best JOIN steps USING (step) JOIN scored USING (step)""")
def _(spark, d):
    _, spec, _, path = _path(spark, d)
    best = choose(path, spec)
    terms = F.array(*[F.lit(t) for t in spec.terms])
    long = best.select("criterion", "step", "dof", rnd("score").alias("score"),
                       F.posexplode("beta").alias("i", "beta"))
    return long.select("criterion", "step", F.element_at(terms, F.col("i") + 1).alias("term"),
                       rnd("beta", 8).alias("beta"), "dof", "score")


@query("shrink_ranking", f"""WITH {PATH} SELECT step, dof, CAST(row_number() OVER (ORDER BY bic, step) AS INTEGER) AS place FROM scored""")
def _(spark, d):
    _, spec, _, path = _path(spark, d)
    return rank_steps(path, spec, "bic").select("step", "dof", "place")


_BEST = f"""{PATH}, est AS (SELECT term, n, y, b AS wlse, one_shot,
  (SELECT beta FROM steps s WHERE s.term = w.term AND s.step = (SELECT step FROM scored ORDER BY aic, step LIMIT 1)) AS aic,
  (SELECT beta FROM steps s WHERE s.term = w.term AND s.step = (SELECT step FROM scored ORDER BY bic, step LIMIT 1)) AS bic
  FROM wl w)"""


@query("loglik_multi", f"WITH {_BEST} SELECT CAST(sum(n) AS BIGINT) AS n, " + ", ".join(
    f"round(sum(y * -ln(1 + exp(-{m})) + (n - y) * -ln(1 + exp({m}))), 4) AS loglik_{m}" for m in METHODS) + " FROM est")
def _(spark, d):
    rows, spec, combined, path = _path(spark, d)
    out = loglik(rows, spec, estimates(combined, path, spec), METHODS)
    return out.select("n", *[rnd(f"loglik_{m}", 4).alias(f"loglik_{m}") for m in METHODS])


@query("predict_prob", f"""WITH {CELLS} SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-b)), 8) AS prob
FROM ship JOIN wl ON term = 'cell_' || ship.cell""")
def _(spark, d):
    rows, spec, combined, _ = _path(spark, d)
    whole = shipments(spark, d)
    return predict(whole, spec, combined, "wlse", ["l_orderkey", "l_linenumber", "l_partkey"]).withColumn(
        "prob", rnd("prob", 8))


@query("coef_compare", f"""WITH {_BEST} SELECT coalesce(e.term, m.term) AS term, round(mle, 6) + 0.0 AS mle,
  round(aic, 8) + 0.0 AS aic, round(bic, 8) + 0.0 AS bic, round(wlse, 8) + 0.0 AS wlse, round(one_shot, 8) + 0.0 AS one_shot
FROM est e FULL JOIN (SELECT term, ln(y / (n - y)) AS mle FROM est) m ON e.term = m.term""")
def _(spark, d):
    rows, spec, combined, path = _path(spark, d)
    ours = coefficients_wide(
        coefficients(estimates(combined, path, spec), spec, {m: m for m in METHODS}), spec, list(METHODS))
    x = ml.term_features(rows, spec).persist()
    mle = ml.model_coefficients(x, ml.fit_logistic(x, intercept=False), spec.terms, False)
    x.unpersist()
    both = compare(mle.withColumnRenamed("estimate", "mle"), ours)
    return both.select("term", rnd("mle").alias("mle"), *[rnd(m, 8).alias(m) for m in ("aic", "bic", "wlse", "one_shot")])


@query("coef_cut", f"""WITH {CELLS} SELECT term, CASE WHEN abs(b) < 0.05 THEN 0.0 ELSE round(b, 8) END AS wlse FROM wl""")
def _(spark, d):
    _, spec, summary = _cells(spark, d)
    wide = coefficients_wide(coefficients(combine(summary, spec), spec, {"wlse": "wlse"}), spec, ["wlse"])
    return cut(wide, "wlse", 0.05).withColumn("wlse", rnd("wlse", 8))


# Models with continuous terms: no closed form, so the score equations are the test ---------

def dense_model(spark, d):
    """Intercept, four standardised continuous terms and two factors."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = stage(shipments(spark, d).select(
        "partition_id", "returned", "o_orderpriority", "l_linestatus", *columns), "shipments")
    spec = factor_spec(rows, "returned", ["o_orderpriority", "l_linestatus"], continuous=columns,
                       baseline="first", intercept=True)
    return rows, spec.with_scales(describe(rows, columns))


@query("chunk_fit_dense_check", f"""WITH {SHIP} SELECT partition_id, count(*) AS n, 'ok' AS status, true AS stationary
FROM ship GROUP BY 1""")
def _(spark, d):
    rows, spec = dense_model(spark, d)
    summary = settle(fit_chunks(rows, spec))
    by_chunk = TermSpec(spec.response, spec.continuous, spec.factors, spec.intercept, ("partition_id",), spec.scales)
    score = score_check(rows, by_chunk, summary, "theta", ["partition_id"])
    return score.join(summary.select("partition_id", "status"), "partition_id").select(
        "partition_id", "n", "status", (F.col("score") < 1e-6).alias("stationary"))


@query("shrink_dense_check", f"""WITH {SHIP} SELECT count(*) AS n_used, true AS ends_at_wlse, true AS rss_falls,
  true AS within_full FROM ship""")
def _(spark, d):
    rows, spec = dense_model(spark, d)
    combined = settle(combine(fit_chunks(rows, spec), spec))
    path = settle(shrink_path(combined, spec, "lasso"))
    last = path.agg(F.max_by("beta", "step").alias("beta"), F.min("rss").alias("low"),
                    F.max_by("rss", "step").alias("final"), F.min("aic").alias("aic"),
                    F.max_by("aic", "step").alias("full_aic"))
    whole = combined.select("n_used", "wlse").first()
    wlse = F.array(*[F.lit(b) for b in whole["wlse"]])
    gap = F.array_max(F.zip_with(wlse, "beta", lambda a, b: F.abs(a - b)))
    return last.select(F.lit(whole["n_used"]).cast("bigint").alias("n_used"), (gap < 1e-8).alias("ends_at_wlse"),
                       (F.col("final") <= F.col("low") + 1e-8).alias("rss_falls"),
                       (F.col("aic") <= F.col("full_aic") + 1e-9).alias("within_full"))


@query("main_job_cells", f"""WITH {_BEST} SELECT term, round(wlse, 8) + 0.0 AS wlse, round(one_shot, 8) + 0.0 AS one_shot,
  round(aic, 8) + 0.0 AS aic, round(bic, 8) + 0.0 AS bic FROM est""")
def _(spark, d):
    # The whole job on rows that bring their chunk numbers: levels, fits, combine, path, choice.
    with fit(shipments(spark, d), Plan("late", keep_top={"cell": 1.0}, intercept=False)) as out:
        pass  # what is used below is stored; the prepared rows are released
    wide = coefficients_wide(out.coefficients(), out.spec, list(METHODS))
    return wide.select("term", *[rnd(m, 8).alias(m) for m in METHODS])


@query("main_job_no_row_key", f"""WITH {CELLS} SELECT term, CAST((SELECT sum(n) FROM wl) AS BIGINT) AS n_used,
  true AS near_mle FROM wl""")
def _(spark, d):
    # Rows with nothing to tell them apart: chunks are drawn, and the estimate stays near the cell log odds.
    rows = shipments(spark, d).select("cell", "late")
    with fit(rows, Plan("late", keep_top={"cell": 1.0}, intercept=False, rows_per_chunk=5000)) as out:
        n_used = out.combined.first()["n_used"]
    odds = rows.groupBy("cell").agg(F.sum("late").alias("y"), F.count("*").alias("n")).select(
        F.concat(F.lit("cell_"), "cell").alias("term"), F.log(F.col("y") / (F.col("n") - F.col("y"))).alias("mle"),
        F.sqrt(F.col("n") / (F.col("y") * (F.col("n") - F.col("y")))).alias("error"))
    wide = coefficients_wide(coefficients(out.combined, out.spec, {"wlse": "wlse"}), out.spec, ["wlse"])
    return wide.join(odds, "term").select("term", F.lit(n_used).cast("bigint").alias("n_used"),
                                          (F.abs(F.col("wlse") - F.col("mle")) < F.col("error") / 2).alias("near_mle"))


@query("model_extend_twice", _WLSE)
def _(spark, d):
    # Three slices, the model stored and extended in between: all chunks count in the end.
    rows = stage(shipments(spark, d).select("partition_id", "cell", "late"), "slices")
    plan = Plan("late", keep_top={"cell": 1.0}, intercept=False)
    folder = scratch_path(spark, "model")
    with fit(rows.filter("partition_id < 2"), plan) as out:
        out.save(folder)
    for k in (2, 3):
        with extend(rows.filter(F.col("partition_id") == k), plan, folder) as out:
            out.save(folder)
    return _wlse(store.load_table(spark, folder, "combined"), out.spec)


@query("model_extend_retry", _WLSE)
def _(spark, d):
    # A save breaks off before its manifest row and is tried again; a slice given twice adds nothing.
    rows = stage(shipments(spark, d).select("partition_id", "cell", "late"), "slices")
    plan = Plan("late", keep_top={"cell": 1.0}, intercept=False)
    folder = scratch_path(spark, "model")
    with fit(rows.filter("partition_id < 2"), plan) as out:
        out.save(folder, ["0", "1"])
    with extend(rows.filter("partition_id = 2"), plan, folder, ["2"]) as out:
        store.write_parts(folder, summary=out.summary, combined=out.combined)
    for k in ("2", "2", "3", "2"):
        out = extend(rows.filter(F.col("partition_id") == int(k)), plan, folder, [k])
        if out is not None:
            with out:
                out.save(folder, [k])
    return _wlse(combine(store.load_table(spark, folder, "summary"), store.load_spec(spark, folder)), store.load_spec(spark, folder))


_STREAM = CELLS.replace("FROM ship GROUP BY partition_id, cell", """FROM (SELECT late, cell,
    CASE WHEN l_orderkey % 3 = 1 THEN 2 ELSE l_orderkey % 3 END AS partition_id FROM ship
  WHERE NOT (l_orderkey % 3 = 1 AND late = 1)) GROUP BY partition_id, cell""")


@query("stream_one_class", f"""WITH {_STREAM} SELECT term, round(b, 8) + 0.0 AS wlse, CAST((SELECT sum(n) FROM wl) AS BIGINT) AS n_used,
  CAST((SELECT sum(n) FROM wl) AS BIGINT) AS n_total FROM wl""")
def _(spark, d):
    # Three file batches; all rows of the second are of one class and wait for the third.
    rows = shipments(spark, d).withColumn("partition_id", F.pmod("l_orderkey", F.lit(3)).cast("bigint")).select("partition_id", "cell", "late")
    rows = stage(rows.filter("NOT (partition_id = 1 AND late = 1)"), "slices")
    spec = factor_spec(rows, "late", ["cell"])
    inbox, folder, state = (scratch_path(spark, name) for name in ("inbox", "model", "state"))
    plan = Plan("late", keep_top={"cell": 1.0}, intercept=False)
    for k in range(3):
        rows.filter(F.col("partition_id") == k).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        stream_model(stream, plan, folder, state, spec).awaitTermination()
    return _wlse(store.load_table(spark, folder, "combined"), spec, "n_total")


@query("unseen_levels", f"""WITH {SHIP} SELECT cell AS level, count(*) AS n FROM ship WHERE cell LIKE '5-LOW%' GROUP BY 1
UNION ALL SELECT 'fitted', count(*) FROM ship WHERE cell NOT LIKE '5-LOW%'
UNION ALL SELECT 'fitted with others', count(*) FROM ship""")
def _(spark, d):
    # Levels that the term list was not made from: counted and left out, or taken as others.
    rows, _ = cell_model(spark, d)
    spec = factor_spec(rows.filter(~F.col("cell").startswith("5-LOW")), "late", ["cell"])
    others = TermSpec("late", (), (Factor.build("cell", [*spec.factors[0].levels, OTHERS]),))
    parts = [unseen_rows(rows, spec).select("level", "n")]
    for name, terms in (("fitted", spec), ("fitted with others", others)):
        parts.append(combine(fit_chunks(rows, terms), terms).select(F.lit(name).alias("level"), F.col("n_used").alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("standardise_constant", """SELECT count(*) AS n, CAST(0 AS DOUBLE) AS constant, CAST(0 AS DOUBLE) AS single,
  round(sum((l_quantity - m) / s * ((l_quantity - m) / s)) + 1, 4) AS squares
FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem)""")
def _(spark, d):
    # A column without spread, and one with the statistics of a single row, become 0.
    rows = table(spark, d, "lineitem").select("l_quantity", F.lit(5.0).alias("same"))
    stats = {r["col"]: (r["mean"], r["sd"]) for r in describe(rows, ["l_quantity", "same"]).collect()}
    out = standardise_columns(rows.withColumn("one", F.col("l_quantity")), {**stats, "one": (7.0, None)})
    return out.agg(F.count("*").alias("n"), F.max(F.abs("same")).alias("constant"), F.max(F.abs("one")).alias("single"),
                   F.round(F.sum(F.col("l_quantity") * F.col("l_quantity")) + 1, 4).alias("squares"))


@query("fit_in_place_check", """SELECT count(*) AS n_total, true AS all_used, true AS near_mle FROM lineitem""")
def _(spark, d):
    # Chunks cut from the scan itself; their average must lie close to the fit of all rows.
    rows = table(spark, d, "lineitem").withColumn("late", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    spec = factor_spec(rows, "late", ["l_linestatus"], continuous=["l_quantity", "l_discount"],
                       baseline="first", intercept=True).with_scales(describe(rows, ["l_quantity", "l_discount"]))
    combined = settle(combine(fit_in_place(rows, spec, rows_per_chunk=2000), spec))
    score = score_check(rows.withColumn("all", F.lit(1)), spec, combined, "wlse", ["all"])
    # The score at the estimate: its own noise is sqrt(n / 4), small chunks add a bias per row.
    whole = combined.first()
    return score.select(F.lit(whole["n_total"]).cast("bigint").alias("n_total"),
                        F.lit(whole["n_total"] == whole["n_used"]).alias("all_used"),
                        (F.col("score") < F.sqrt(F.col("n")) + 0.001 * F.col("n")).alias("near_mle"))


@query("main_job", f"""WITH {SHIP} SELECT count(*) AS n, true AS wlse_beats_one_shot_or_near, true AS below_zero FROM ship""")
def _(spark, d):
    rows = shipments(spark, d)
    plan = Plan("returned", ["l_quantity", "l_extendedprice", "l_discount"],
                {"o_orderpriority": 1.0, "l_linestatus": 1.0}, baseline="first",
                row_key=["l_orderkey", "l_linenumber", "l_partkey"], rows_per_chunk=5000)
    with fit(rows, plan) as found:
        out = settle(found.evaluation())
    return out.select("n", (F.col("loglik_wlse") >= F.col("loglik_one_shot") - 1e-4 * F.col("n")).alias(
        "wlse_beats_one_shot_or_near"),
                      (F.col("loglik_wlse") < 0).alias("below_zero"))


# Baselines -------------------------------------------------------------------------------

_SATURATED = f"""WITH {SHIP}, c AS (SELECT l_linestatus, ln(CAST(sum(late) AS DOUBLE) / (count(*) - sum(late))) AS b
  FROM ship GROUP BY 1), base AS (SELECT b AS b0 FROM c WHERE l_linestatus = 'F')
SELECT 'intercept' AS term, round(b0, 6) + 0.0 AS estimate FROM base UNION ALL
SELECT 'l_linestatus_' || l_linestatus, round(b - b0, 6) + 0.0 FROM c, base WHERE l_linestatus <> 'F'"""


def _saturated(spark, d):
    rows = shipments(spark, d).select("l_linestatus", "late", "partition_id")
    return rows, factor_spec(rows, "late", ["l_linestatus"], baseline="first", intercept=True)


@query("ml_logistic_saturated", _SATURATED)
def _(spark, d):
    rows, spec = _saturated(spark, d)
    x = ml.term_features(rows, spec).persist()
    out = ml.model_coefficients(x, ml.fit_logistic(x), spec.terms[1:], True)
    x.unpersist()
    return out.withColumn("estimate", rnd("estimate"))


@query("chunk_fit_saturated", _SATURATED)
def _(spark, d):
    # One chunk: the combined estimate is the maximum-likelihood estimate.
    rows, spec = _saturated(spark, d)
    combined = combine(fit_chunks(rows.withColumn("partition_id", F.lit(0).cast("bigint")), spec), spec)
    return coefficients(combined, spec, {"mle": "wlse"}).select("term", rnd("estimate").alias("estimate"))


@query("ml_loglik", f"""WITH {SHIP}, c AS (SELECT l_linestatus, CAST(count(*) AS DOUBLE) AS n, CAST(sum(late) AS DOUBLE) AS y
  FROM ship GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(y * ln(y / n) + (n - y) * ln(1 - y / n)), 3) AS loglik FROM c""")
def _(spark, d):
    rows, spec = _saturated(spark, d)
    x = ml.term_features(rows, spec).persist()
    return ml.model_loglik(x, ml.fit_logistic(x)).withColumn("loglik", rnd("loglik", 3))


@query("lbfgs_cells", f"WITH {CELLS} SELECT term, round(ln(y / (n - y)), 6) + 0.0 AS estimate FROM wl")
def _(spark, d):
    rows, spec = cell_model(spark, d)
    x = ml.term_features(rows, spec).persist()
    out = ml.model_coefficients(x, ml.fit_logistic(x, intercept=False), spec.terms, False)
    x.unpersist()
    return out.withColumn("estimate", rnd("estimate"))


@query("ml_onehot_fit", f"""WITH {SHIP} SELECT count(*) AS n, true AS finite FROM ship""")
def _(spark, d):
    rows, spec = dense_model(spark, d)
    x = ml.features(rows, spec).select("label", "features").persist()
    out = ml.model_loglik(x, ml.fit_logistic(x, tol=1e-8))
    return out.select("n", ((F.col("loglik") < 0) & ~F.isnan("loglik")).alias("finite"))


_ZERO_TERMS = ["l_discount", "l_extendedprice", "l_quantity", "l_tax", "o_orderpriority_2-HIGH",
               "o_orderpriority_3-MEDIUM", "o_orderpriority_4-NOT SPECIFIED", "o_orderpriority_5-LOW",
               "l_linestatus_O"]


@query("elastic_net", f"""WITH {SHIP} SELECT 'intercept' AS term,
  round(ln(CAST(sum(returned) AS DOUBLE) / (count(*) - sum(returned))), 6) + 0.0 AS estimate FROM ship UNION ALL
SELECT term, 0.0 FROM (VALUES """ + ", ".join(f"('{t}')" for t in _ZERO_TERMS) + ") v(term)")
def _(spark, d):
    # At this penalty every slope is zero, and the intercept is the log odds of the response.
    rows, spec = dense_model(spark, d)
    x = ml.term_features(rows, spec).persist()
    model = ml.fit_elastic_net(x, reg=0.3, elastic=0.8)
    x.unpersist()
    return ml.model_coefficients(x, model, spec.terms[1:], True).withColumn("estimate", rnd("estimate"))


@query("sgd_averaged", f"""WITH {SHIP}, t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(returned) AS DOUBLE) AS y FROM ship)
SELECT CAST(n AS BIGINT) AS n, round(y * ln(y / n) + (n - y) * ln(1 - y / n), 2) AS loglik_null, true AS near FROM t""")
def _(spark, d):
    # The predictors carry next to no signal, so a sound fit lies close to the intercept-only one.
    rows, spec = dense_model(spark, d)
    theta = fit_sgd(rows, spec, epochs=3)
    share = rows.agg(F.avg("returned")).first()[0]
    null = [math.log(share / (1 - share))] + [0.0] * (spec.p - 1)
    out = loglik(rows, spec, constants({"sgd": theta, "null": null}, spark), ["sgd", "null"])
    near = F.abs(F.col("loglik_sgd") / F.col("loglik_null") - 1) < 0.01
    return out.select("n", rnd("loglik_null", 2).alias("loglik_null"), near.alias("near"))


__all__ = ["ORACLES", "QUERIES"]
