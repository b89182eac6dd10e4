"""Registered queries: the ways that hold for very many levels, ill-conditioned regressors and stored pieces."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from onefold.catalog.levels import EVENT_TOP, PART_TOP, _picked_sql
from onefold.catalog.models import cell_model, dense_model
from onefold.catalog.tables import CELLS, SHIP, factor_spec, rnd, shipments, table
from onefold.operators.chunkfit import fit_chunks
from onefold.operators.chunks import bucketed
from onefold.operators.combine import combine
from onefold.operators.heavy import merge_sketches, select_heavy_levels, sketch_levels
from onefold.operators.penalised import penalised_path
from onefold.operators.permute import random_index
from onefold.operators.qr import group_ols_qr
from onefold.operators.stats import describe, merge_quantiles, merge_stats, quantile_sketches, quantiles
from onefold.plans import ml
from onefold.plans.regression import Plan, fit, input_counts
from onefold.plans.sgd import fit_sgd
from onefold.session import settle, stage

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_KEPT = """SELECT factor, level, n, total, rank, cum_n, round(cum_frac, 9) AS cum_frac, kept FROM picked WHERE kept UNION ALL
SELECT factor, '000_OTHERS', CAST(sum(n) AS BIGINT), any_value(total), NULL, any_value(total), 1.0, false FROM picked WHERE NOT kept GROUP BY factor"""


def _kept(levels):
    return levels.withColumn("cum_frac", rnd("cum_frac", 9))


@query("level_select_heavy", f"WITH {_picked_sql('events', EVENT_TOP)} {_KEPT}")
def _(spark, d):
    # Sketches of three slices are merged. Few candidates and buckets, so that the proof finds buckets to recount.
    rows = table(spark, d, "events").select("event_id", *EVENT_TOP)
    slices = [rows.filter(F.pmod("event_id", F.lit(3)) == i) for i in range(3)]
    sketches = settle(merge_sketches(*[sketch_levels(s, list(EVENT_TOP), 16) for s in slices], candidates=16))
    return _kept(select_heavy_levels(rows, EVENT_TOP, candidates=16, buckets=256, sketches=sketches))


@query("level_select_heavy_10pct", f"WITH {_picked_sql('part', PART_TOP, 0.1)} {_KEPT}")
def _(spark, d):
    return _kept(select_heavy_levels(table(spark, d, "part"), PART_TOP, min_share=0.1))


# Ill-conditioned least squares -------------------------------------------------------------

_NEAR = 1e-4

_OLS_PAIR = """SELECT l_linenumber, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2,
  covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_discount, l_discount) AS s22,
  covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2 FROM lineitem GROUP BY 1"""


@query("group_ols_qr", f"""WITH m AS ({_OLS_PAIR}), s AS (SELECT *, (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS b1,
  (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS b2 FROM m)
SELECT l_linenumber, n, round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(b1, 4) AS on_quantity, round(b2, 1) AS on_discount FROM s""")
def _(spark, d):
    # The second regressor is the first plus a trace of the discount. Their sums of squares agree in nine digits; an exact
    # change of variables gives the coefficients of quantity and discount back.
    rows = table(spark, d, "lineitem").withColumn("almost", F.col("l_quantity") + F.lit(_NEAR) * F.col("l_discount"))
    out = group_ols_qr(rows, "l_linenumber", "l_extendedprice", ["l_quantity", "almost"])
    return out.select("l_linenumber", "n", rnd("intercept", 3).alias("intercept"),
                      rnd(F.col("l_quantity") + F.col("almost"), 4).alias("on_quantity"), rnd(F.col("almost") * F.lit(_NEAR), 1).alias("on_discount"))


# Penalised estimates from summaries ----------------------------------------------------------

_REGS = [0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001]
_MIX = 0.7


@query("penalised_cells", f"""WITH {CELLS}, t AS (SELECT sum(n) AS n FROM wl), r AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(_REGS))}) v(step, reg))
SELECT CAST(step AS INTEGER) AS step, term, round(CASE WHEN abs(h * b / t.n) <= reg * {_MIX}::DOUBLE THEN 0
  ELSE sign(b) * (abs(h * b / t.n) - reg * {_MIX}::DOUBLE) / (h / t.n + reg * (1 - {_MIX}::DOUBLE)) END, 8) + 0.0 AS beta FROM wl, t, r""")
def _(spark, d):
    # A diagonal Hessian: every coefficient is soft-thresholded by itself.
    rows, spec = cell_model(spark, d)
    path = penalised_path(combine(fit_chunks(rows, spec), spec), spec, _MIX, _REGS)
    terms = F.array(*[F.lit(t) for t in spec.terms])
    return path.select("step", F.inline(F.arrays_zip(terms.alias("term"), "beta"))).withColumn("beta", rnd("beta", 8))


@query("penalised_dense_check", f"""WITH {SHIP} SELECT count(*) AS n_used, CAST(50 AS BIGINT) AS steps, true AS optimal, true AS starts_at_zero, true AS some_slopes,
  true AS nears_wlse FROM ship""")
def _(spark, d):
    # No closed form: the conditions of an optimum hold at every step, from no slope to nearly the full estimate.
    rows, spec = dense_model(spark, d)
    combined = settle(combine(fit_chunks(rows, spec), spec))
    path = settle(penalised_path(combined, spec, 0.8))
    whole = combined.first()
    wlse = F.array(*[F.lit(b) for b in whole["wlse"]])
    gap = F.array_max(F.zip_with(wlse, F.max_by("beta", "step"), lambda x, y: F.abs(x - y)))
    size = max(abs(b) for b in whole["wlse"][1:])
    return path.agg(
        F.lit(whole["n_used"]).cast("bigint").alias("n_used"), F.count("*").alias("steps"), (F.max("gap") < 1e-6).alias("optimal"),
        (F.min_by("dof", "step") <= 1).alias("starts_at_zero"), ((F.max("dof") > 3) & (F.count_if((F.col("dof") > 0) & (F.col("dof") < spec.p - 1)) > 3)).alias("some_slopes"),
        (gap < 0.1 * size).alias("nears_wlse"))


# Averaged descent in one stage --------------------------------------------------------------

_BOUGHT = """CASE WHEN l_quantity > CASE left(o_orderpriority, 1) WHEN '1' THEN 10 WHEN '2' THEN 18 WHEN '3' THEN 25 WHEN '4' THEN 33 ELSE 40 END
  THEN 1 ELSE 0 END"""


@query("sgd_signal", f"""WITH {SHIP}, c AS (SELECT o_orderpriority, count(*) AS n, CAST(sum({_BOUGHT}) AS DOUBLE) AS y FROM ship GROUP BY 1)
SELECT 'o_orderpriority_' || o_orderpriority AS term, CAST(n AS BIGINT) AS n, round(ln(y / (n - y)), 6) AS log_odds, true AS near, true AS same FROM c""")
def _(spark, d):
    # Strong effects: the passes in one barrier stage, and the same passes as jobs, end near the log odds of every level.
    rows = stage(shipments(spark, d).withColumn("bought", F.expr(_BOUGHT)).select("bought", "o_orderpriority"), "bought")
    spec = factor_spec(rows, "bought", ["o_orderpriority"])
    fits = [fit_sgd(rows, spec, epochs=16, parts=4, batch_rows=32, barrier=b) for b in (True, False)]
    found = spark.createDataFrame(list(zip(spec.terms, *fits, strict=True)), "term string, b double, jobs double")
    odds = rows.groupBy(F.concat(F.lit("o_orderpriority_"), "o_orderpriority").alias("term")).agg(
        F.count("*").alias("n"), F.log(F.sum("bought") / (F.count("*") - F.sum("bought"))).alias("log_odds"))
    return odds.join(F.broadcast(found), "term").select(
        "term", "n", rnd("log_odds").alias("log_odds"), (F.abs(F.col("b") - F.col("log_odds")) < 0.15).alias("near"),
        (F.abs(F.col("b") - F.col("jobs")) < 1e-9).alias("same"))


# Permutations and stored pieces ---------------------------------------------------------------

@query("random_permutation", """SELECT count(*) AS n, CAST(0 AS BIGINT) AS least, count(*) - 1 AS most, count(*) AS different, true AS repeatable, true AS mixed FROM orders""")
def _(spark, d):
    # Row numbers 0..n-1 in random order, the same from 2 and from 40 partitions, and unrelated to the order of the key.
    orders = table(spark, d, "orders").select("o_orderkey")
    few = random_index(orders.repartition(2), ["o_orderkey"], 7, parts=2)
    many = random_index(orders.repartition(40), ["o_orderkey"], 7, parts=40)
    both = few.join(many.withColumnRenamed("row_id", "again"), "o_orderkey")
    return both.agg(
        F.count("*").alias("n"), F.min("row_id").alias("least"), F.max("row_id").alias("most"), F.countDistinct("row_id").alias("different"),
        F.every(F.col("row_id") == F.col("again")).alias("repeatable"), (F.abs(F.corr("row_id", "o_orderkey")) < 5 / F.sqrt(F.count("*"))).alias("mixed"))


_STAT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("stats_merged", " UNION ALL ".join(f"""SELECT '{c}' AS col, count({c}) AS n, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS sd,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""" for c in _STAT_COLUMNS))
def _(spark, d):
    rows = table(spark, d, "lineitem")
    slices = [rows.filter(F.pmod("l_orderkey", F.lit(7)).isin(*part)) for part in ([0], [1, 2, 3], [4, 5, 6])]
    merged = merge_stats(merge_stats(*[describe(s, _STAT_COLUMNS) for s in slices[:2]]), describe(slices[2], _STAT_COLUMNS))
    return merged.withColumns({"mean": rnd("mean", 8), "sd": rnd("sd", 8)})


_SHARES = [0.1, 0.5, 0.9]


@query("quantiles_merged", " UNION ALL ".join(f"SELECT '{c}' AS col, {s}::DOUBLE AS share, true AS near FROM region WHERE r_regionkey = 0"
                                               for c in _STAT_COLUMNS for s in _SHARES))
def _(spark, d):
    # Quantiles of merged sketches; of all rows the share below them is as wanted, to two per cent.
    rows = table(spark, d, "lineitem").select("l_orderkey", *_STAT_COLUMNS)
    slices = [rows.filter(F.pmod("l_orderkey", F.lit(3)) == i) for i in range(3)]
    found = settle(quantiles(merge_quantiles(*[quantile_sketches(s, _STAT_COLUMNS) for s in slices]), _SHARES))
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("x")) for c in _STAT_COLUMNS])))
    placed = long.join(F.broadcast(found), "col").groupBy("col", "share").agg(
        F.avg((F.col("x") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("x") <= F.col("value")).cast("int")).alias("upto"))
    return placed.select("col", "share", ((F.col("below") <= F.col("share") + 0.02) & (F.col("upto") >= F.col("share") - 0.02)).alias("near"))


@query("chunk_table_bucketed", f"""WITH {CELLS} SELECT term, round(b, 8) + 0.0 AS wlse, round(one_shot, 8) + 0.0 AS one_shot,
  CAST(n AS BIGINT) AS n, round(ln(y / n), 8) + 0.0 AS log_share FROM wl""")
def _(spark, d):
    # Rows stored by chunk once: the fit and the counts per chunk read the buckets as they are. There are four chunks at any
    # size, so their rows are added up by cell before they reach Python; on the bucket columns that needs no shuffle either.
    ship = shipments(spark, d).select("partition_id", "cell", "late")
    rows = bucketed(ship, ["partition_id"], 8)
    spec = factor_spec(rows, "late", ["cell"])
    combined = combine(fit_chunks(rows, spec), spec)
    counts = rows.groupBy("partition_id", "cell").agg(F.count("*").alias("n"), F.sum("late").alias("y"))
    shares = counts.groupBy(F.concat(F.lit("cell_"), "cell").alias("term")).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    terms = F.array(*[F.lit(t) for t in spec.terms])
    long = combined.select(F.inline(F.arrays_zip(terms.alias("term"), "wlse", "one_shot")))
    return shares.join(F.broadcast(long), "term").select(
        "term", rnd("wlse", 8).alias("wlse"), rnd("one_shot", 8).alias("one_shot"), "n", rnd(F.log(F.col("y") / F.col("n")), 8).alias("log_share"))


# Spark ML as a job ---------------------------------------------------------------------------

_CELL_TOP = 0.65

_ML_JOB = f"""{SHIP}, counts AS (SELECT cell, count(*) AS n, CAST(sum(late) AS DOUBLE) AS y FROM ship GROUP BY 1), ranked AS (
  SELECT *, CAST(sum(n) OVER (ORDER BY n DESC, cell ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS cum FROM counts), kept AS (
  SELECT 'cell_' || CASE WHEN cum <= CAST({_CELL_TOP} AS DOUBLE) THEN cell ELSE '000_OTHERS' END AS term, sum(n) AS n, sum(y) AS y FROM ranked GROUP BY 1)"""


@query("ml_job", f"""WITH {_ML_JOB}, t AS (SELECT sum(y * ln(y / n) + (n - y) * ln(1 - y / n)) AS loglik, CAST(sum(n) AS BIGINT) AS n FROM kept)
SELECT term, round(ln(kept.y / (kept.n - kept.y)), 6) + 0.0 AS estimate, t.n, round(loglik, 3) AS loglik FROM kept, t""")
def _(spark, d):
    # Levels selected and collapsed, coded, fitted by L-BFGS on all rows and scored, as one job.
    found = ml.ml_job(shipments(spark, d), Plan("late", keep_top={"cell": _CELL_TOP}, intercept=False))
    score = found.loglik.first()
    return found.coefficients.select("term", rnd("estimate").alias("estimate"), F.lit(score["n"]).cast("bigint").alias("n"),
                                     rnd(F.lit(score["loglik"]), 3).alias("loglik"))


@query("onehot_others", f"""WITH {_picked_sql("part", PART_TOP, 0.1)}
SELECT term, n, CAST(row_number() OVER (ORDER BY CASE factor {" ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(PART_TOP))} END, level) - 1 AS INTEGER) AS at,
  CAST(count(*) OVER () AS INTEGER) AS width FROM terms""")
def _(spark, d):
    # Selection with the 10 per cent rule, dropped levels as OTHERS, one-hot vector; its columns add up to the counts.
    rows = table(spark, d, "part").select(*PART_TOP)
    first, dictionary = ml.onehot_selected(rows, PART_TOP, min_share=0.1)
    # A stored dictionary gives other rows the same positions.
    hot, _ = ml.onehot_selected(first.drop("features_ONEHOT"), PART_TOP, dictionary=dictionary)
    sums = hot.select(F.size("features_ONEHOT").alias("width"), F.posexplode("features_ONEHOT").alias("at", "x")).groupBy("at", "width").agg(
        F.sum("x").cast("bigint").alias("n"))
    order = F.array_position(F.array(*[F.lit(f) for f in PART_TOP]), F.col("factor"))
    named = dictionary.select(F.array_sort(F.collect_list(F.struct(order.alias("f"), "level", "term")).over(Window.partitionBy())).alias("all")).limit(1)
    named = named.select(F.posexplode("all").alias("at", "t")).select("at", "t.term")
    return sums.join(F.broadcast(named), "at").select("term", "n", "at", "width")


@query("elastic_net_signal", f"""WITH {SHIP} SELECT 'o_orderpriority_' || o_orderpriority AS term, count(*) AS n, true AS optimal,
  left(o_orderpriority, 1) <> '3' AS strong FROM ship GROUP BY 1, 4""")
def _(spark, d):
    # Slopes that are not zero: for each the mean score equals its penalty.
    reg, mix = 0.02, 0.6
    rows = stage(shipments(spark, d).withColumn("bought", F.expr(_BOUGHT)).select("bought", "o_orderpriority"), "bought")
    spec = factor_spec(rows, "bought", ["o_orderpriority"], intercept=True)
    x = ml.term_features(rows, spec).persist()
    model = ml.fit_logistic(x, True, 500, 1e-12, reg, mix)
    slopes = ml.model_coefficients(x, model, spec.terms[1:], False)
    x.unpersist()
    whole = rows.count()
    sums = rows.groupBy(F.concat(F.lit("o_orderpriority_"), "o_orderpriority").alias("term")).agg(F.count("*").alias("n"), F.sum("bought").alias("y"))
    b = F.col("estimate")
    pull = (F.col("y") - F.col("n") / (1 + F.exp(-b - F.lit(float(model.intercept))))) / whole - reg * (1 - mix) * b
    gap = F.when(b != 0, F.abs(pull - reg * mix * F.signum(b))).otherwise(F.greatest(F.abs(pull) - reg * mix, F.lit(0.0)))
    return sums.join(F.broadcast(slopes), "term").select("term", "n", (gap < 1e-6).alias("optimal"), (F.abs(b) > 0.1).alias("strong"))


@query("run_counts", """SELECT count(*) AS rows_read, CAST(count_if(l_linenumber = 7) AS BIGINT) AS nulls_tax, count_if(l_linenumber <> 7) AS rows_used,
  count_if(l_linenumber <> 7) AS n_total, CAST(4 AS BIGINT) AS chunks FROM lineitem""")
def _(spark, d):
    # Rows, nulls and chunks of a run whose rows draw their chunks.
    rows = table(spark, d, "lineitem").select("l_linestatus", F.when(F.col("l_linenumber") != 7, F.col("l_tax")).alias("tax"), "l_discount")
    rows = rows.withColumn("y", F.when(F.col("l_discount") > 0.05, 1).otherwise(0))
    plan = Plan("y", ["tax"], {"l_linestatus": 1.0}, baseline="first")
    seen = input_counts(rows, plan).first()
    with fit(rows, replace(plan, rows_per_chunk=-(-seen["rows_used"] // 4))) as out:
        total = out.combined.first()
    counts = (seen["rows_read"], seen["nulls_tax"], seen["rows_used"], total["n_total"], total["chunks_total"])
    return spark.createDataFrame([counts], "rows_read long, nulls_tax long, rows_used long, n_total long, chunks long")
