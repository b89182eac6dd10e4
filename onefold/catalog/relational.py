"""Registered queries: projection, joins, aggregates, windows, sorting, sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from onefold.catalog.tables import LINE_KEY, SHIP, rnd, shipments, table
from onefold.functions import (
    bernoulli, cut_small, group_of, has_nan, linear_predictor, log_density, log_density_from_prob, logistic,
    standardise, term_name,
)
from onefold.operators import chunks as ch
from onefold.operators import stats as st
from onefold.operators.ols import group_ols
from onefold.operators.prepare import binarise, fill_zero, project, standardise_columns
from onefold.sources.rows import add_logistic, add_uniform, from_local

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


STAT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NULL_TAX = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END"


@query("binarise_label", f"""WITH {SHIP}
SELECT l_orderkey, l_linenumber, late, CAST(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS INTEGER) AS taxed FROM ship""")
def _(spark, d):
    rows = shipments(spark, d)
    return binarise(rows, "l_tax", 0.04, "taxed").select("l_orderkey", "l_linenumber", "late", "taxed")


@query("dropna_project", f"""SELECT l_orderkey, l_quantity, tax FROM (
  SELECT l_orderkey, l_quantity, {_NULL_TAX} AS tax FROM lineitem) WHERE tax IS NOT NULL""")
def _(spark, d):
    tax = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_tax"))
    return project(table(spark, d, "lineitem").withColumn("tax", tax), ["l_orderkey", "l_quantity", "tax"])


@query("fill_zero", f"SELECT l_orderkey, l_linenumber, l_quantity, coalesce({_NULL_TAX}, 0.0) AS tax FROM lineitem")
def _(spark, d):
    tax = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_tax"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", tax.alias("tax"))
    return fill_zero(rows, ["tax"])


@query("group_id_floor", """SELECT CAST(floor(l_orderkey / 1000) AS INTEGER) AS id, count(*) AS n,
  round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(group_of(F.col("l_orderkey"), 1000).alias("id"), "l_quantity")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity"), 2).alias("quantity"))


@query("nan_check", f"""SELECT l_linenumber, bool_or(tax IS NULL) AS has_nan, count(*) AS n
FROM (SELECT l_linenumber, {_NULL_TAX} AS tax FROM lineitem) GROUP BY l_linenumber""")
def _(spark, d):
    tax = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_tax"))
    rows = table(spark, d, "lineitem").select("l_linenumber", has_nan(F.array(tax, "l_quantity")).alias("bad"))
    return rows.groupBy("l_linenumber").agg(F.bool_or("bad").alias("has_nan"), F.count(F.lit(1)).alias("n"))


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    return st.row_count(table(spark, d, "lineitem"))


_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS col, count({c}) AS n, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS sd, "
    f"min({c}) AS min, max({c}) AS max FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax"])


@query("describe_stats", _DESCRIBE)
def _(spark, d):
    stats = st.describe(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return stats.withColumns({"mean": rnd("mean", 8), "sd": rnd("sd", 8)})


@query("global_mean", "SELECT round(avg(l_quantity), 8) AS mean_l_quantity, round(avg(l_discount), 8) AS mean_l_discount FROM lineitem")
def _(spark, d):
    out = st.column_means(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return out.select(*[rnd(c, 8).alias(c) for c in out.columns])


@query("distinct_labels", "SELECT DISTINCT quality FROM labels")
def _(spark, d):
    return st.distinct_values(table(spark, d, "labels"), "quality")


@query("standardise", """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq,
  avg(l_discount) AS md, stddev_samp(l_discount) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity,
  round((l_discount - md) / sd, 6) + 0.0 AS l_discount FROM lineitem, s""")
def _(spark, d):
    rows = st.standardise_by(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return rows.select("l_orderkey", "l_linenumber", rnd("l_quantity").alias("l_quantity"),
                       rnd("l_discount").alias("l_discount"))


@query("group_demean", """SELECT l_orderkey, l_linenumber, l_partkey,
  round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_partkey), 8) + 0.0 AS centred FROM lineitem""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return st.centre_in_group(rows, "l_partkey", "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_partkey", rnd("centred", 8).alias("centred"))


@query("group_zscore", """SELECT l_orderkey, l_linenumber, l_partkey,
  round((l_quantity - avg(l_quantity) OVER w) / nullif(stddev_samp(l_quantity) OVER w, 0), 6) + 0.0 AS zscore
FROM lineitem WINDOW w AS (PARTITION BY l_partkey)""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return st.zscore_in_group(rows, "l_partkey", "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_partkey", rnd("zscore").alias("zscore"))


def _ols_sql(group: str) -> str:
    return f"""WITH s AS (SELECT {group}, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1,
  avg(l_discount) AS m2, var_samp(l_quantity) AS s11, var_samp(l_discount) AS s22,
  covar_samp(l_quantity, l_discount) AS s12, covar_samp(l_quantity, l_extendedprice) AS s1y,
  covar_samp(l_discount, l_extendedprice) AS s2y FROM lineitem GROUP BY {group}), b AS (
  SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT {group}, n, round(my - b1 * m1 - b2 * m2, 3) + 0.0 AS intercept, round(b1, 4) + 0.0 AS l_quantity,
  round(b2, 3) + 0.0 AS l_discount FROM b"""


def _ols(group: str):
    def run(spark, d):
        out = group_ols(table(spark, d, "lineitem"), group, "l_extendedprice", ["l_quantity", "l_discount"])
        return out.select(group, "n", rnd("intercept", 3).alias("intercept"),
                          rnd("l_quantity", 4).alias("l_quantity"), rnd("l_discount", 3).alias("l_discount"))

    return run


query("group_ols", _ols_sql("l_linenumber"))(_ols("l_linenumber"))
query("group_ols_supplier", _ols_sql("l_suppkey"))(_ols("l_suppkey"))


# Chunks, sorting, slices -----------------------------------------------------------------

@query("chunk_systematic", """SELECT l_orderkey % 20 AS partition_id, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = ch.chunk_systematic(table(spark, d, "lineitem"), "l_orderkey", 20)
    return rows.groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


_ORDER = ", ".join(LINE_KEY)


@query("chunk_by_position", f"""SELECT l_orderkey, l_linenumber, l_partkey,
  (row_number() OVER (ORDER BY {_ORDER}) - 1) % 20 AS partition_id FROM lineitem""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(*LINE_KEY)
    return ch.chunk_by_position(rows, LINE_KEY, 20).select(
        "l_orderkey", "l_linenumber", "l_partkey", "partition_id")


@query("ntile_split", f"""SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(ntile(21) OVER (ORDER BY {_ORDER}) AS INTEGER) AS slice FROM lineitem""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(*LINE_KEY)
    return ch.split_even(rows, LINE_KEY, 21).select("l_orderkey", "l_linenumber", "l_partkey", "slice")


def _balance(rows, k: int):
    # A hash or a draw fills chunks as a fair die would; six standard deviations are allowed.
    counts = rows.groupBy("partition_id").agg(F.count(F.lit(1)).cast("double").alias("c"))
    n = F.sum("c")
    spread = F.max("c")
    return counts.agg(
        n.cast("bigint").alias("n"), F.count(F.lit(1)).alias("chunks"),
        (F.min("partition_id") >= 0).alias("from_zero"), (F.max("partition_id") < k).alias("below_k"),
        (spread <= n / k + 6 * F.sqrt(n / k) + 2).alias("balanced"))


def _balance_sql(k: int, name: str = "lineitem") -> str:
    return f"SELECT count(*) AS n, CAST({k} AS BIGINT) AS chunks, true AS from_zero, true AS below_k, true AS balanced FROM {name}"


@query("chunk_monotonic", _balance_sql(4))
def _(spark, d):
    return _balance(ch.chunk_monotonic(table(spark, d, "lineitem").select("l_orderkey"), 4), 4)


@query("chunk_random", _balance_sql(20))
def _(spark, d):
    return _balance(ch.chunk_random(table(spark, d, "lineitem").select("l_orderkey"), 20, seed=11), 20)


@query("chunk_hash", _balance_sql(20))
def _(spark, d):
    return _balance(ch.chunk_by_hash(table(spark, d, "lineitem").select(*LINE_KEY), LINE_KEY, 20), 20)


@query("chunk_plan", """SELECT o_orderpriority, count(*) AS n, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS chunks
FROM orders GROUP BY 1""")
def _(spark, d):
    return ch.chunk_plan(table(spark, d, "orders"), 1000, ["o_orderpriority"])


@query("shuffle_rows", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return ch.shuffle_rows(rows, seed=5)


@query("spread_by_chunk", "SELECT l_orderkey % 4 AS partition_id, count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = ch.chunk_systematic(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", 4)
    return ch.spread_by_chunk(rows, 4).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top"))


@query("union_slices", """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.pmod(F.xxhash64("l_orderkey"), F.lit(3)).alias("third"))
    whole = ch.append_slices(*[rows.filter(F.col("third") == k) for k in range(3)])
    return whole.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


# Scalars ---------------------------------------------------------------------------------

_ETA = "0.3 + 0.02 * l_quantity - 4.0 * l_discount"


@query("scalar_functions", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount,
  CAST(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS y, CAST({_ETA} AS DOUBLE) AS eta FROM lineitem)
SELECT l_orderkey, l_linenumber, round(eta, 9) + 0.0 AS eta, round(1 / (1 + exp(-eta)), 9) AS prob,
  round(y * ln(1 / (1 + exp(-eta))) + (1 - y) * ln(1 - 1 / (1 + exp(-eta))), 9) AS logdens,
  round((l_quantity - 25.5) / 14.5, 9) + 0.0 AS z, 'flag_' || l_returnflag AS term,
  CAST(sign(eta) AS INTEGER) AS sgn, round(abs(eta), 9) AS size,
  CASE WHEN abs(l_discount - 0.05) < 0.02 THEN 0.0 ELSE round(l_discount - 0.05, 9) END AS cut FROM s""")
def _(spark, d):
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    eta = linear_predictor([F.lit(1.0), F.col("l_quantity"), F.col("l_discount")], [0.3, 0.02, -4.0])
    rows = table(spark, d, "lineitem").withColumn("eta", eta)
    e = F.col("eta")
    return rows.select(
        "l_orderkey", "l_linenumber", rnd(e, 9).alias("eta"), rnd(logistic(e), 9).alias("prob"),
        rnd(log_density(y, e), 9).alias("logdens"),
        rnd(standardise(F.col("l_quantity"), 25.5, 14.5), 9).alias("z"),
        term_name("flag", F.col("l_returnflag")).alias("term"), F.signum(e).cast("int").alias("sgn"),
        rnd(F.abs(e), 9).alias("size"), rnd(cut_small(F.col("l_discount") - 0.05, 0.02), 9).alias("cut"))


@query("loglik_from_prob", """WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  (l_quantity + 1) / 60 AS p1 FROM lineitem)
SELECT count(*) AS n, round(sum(CASE WHEN y = 1 THEN ln(p1) ELSE ln(1 - p1) END), 4) AS loglik FROM s""")
def _(spark, d):
    p1 = (F.col("l_quantity") + 1) / 60
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum(log_density_from_prob(y, 1 - p1, p1)), 4).alias("loglik"))


# Generated and local rows ----------------------------------------------------------------

@query("uniform_rows", """SELECT CAST(floor(l_orderkey / 10000) AS INTEGER) AS id, count(*) AS n, true AS in_range,
  true AS centred FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(group_of(F.col("l_orderkey"), 10000).alias("id"))
    rows = add_uniform(rows, ["y", "x1", "x2"], seed=3)
    low, high = F.least("y", "x1", "x2"), F.greatest("y", "x1", "x2")
    limit = 6 * F.sqrt(1.0 / (12.0 * F.count(F.lit(1))))
    return rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), ((F.min(low) >= 0) & (F.max(high) < 1)).alias("in_range"),
        ((F.abs(F.avg("y") - 0.5) < limit) & (F.abs(F.avg("x1") - 0.5) < limit)).alias("centred"))


@query("simulated_rows", """SELECT o_orderkey % 20 AS partition_id, count(*) AS n, true AS in_range, true AS both_labels
FROM orders GROUP BY 1""")
def _(spark, d):
    rows = add_logistic(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), 10, 20, seed=7)
    xs = [F.col(f"x{j}") for j in range(10)]
    return rows.groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.min(F.least(*xs)) >= -0.5) & (F.max(F.greatest(*xs)) < 0.5)).alias("in_range"),
        ((F.min("label") == 0) & (F.max("label") == 1)).alias("both_labels"))


@query("bernoulli_draw", """SELECT l_returnflag, count(*) AS n, true AS near FROM lineitem GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 51).alias("p"))
    drawn = rows.withColumn("x", bernoulli(F.col("p"), seed=17))
    sd = F.sqrt(F.sum(F.col("p") * (1 - F.col("p"))))
    return drawn.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.sum("x") - F.sum("p")) < 6 * sd).alias("near"))


@query("local_rows_join", """WITH w(priority, weight) AS (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3),
  ('4-NOT SPECIFIED', 2), ('5-LOW', 1))
SELECT o_orderpriority, CAST(weight AS BIGINT) AS weight, count(*) AS n FROM orders
JOIN w ON o_orderpriority = priority GROUP BY 1, 2""")
def _(spark, d):
    import pandas as pd

    # A weight list as a user would type it in.
    given = pd.DataFrame({
        "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
        "weight": [5, 4, 3, 2, 1]})
    weights = F.broadcast(from_local(spark, given, slices=2))
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(weights, F.col("o_orderpriority") == F.col("priority")).select(
        "o_orderpriority", "weight", "n")


@query("standardise_literals", """SELECT o_orderkey, round((o_totalprice - 150000) / 90000, 6) + 0.0 AS o_totalprice FROM orders""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = standardise_columns(rows, {"o_totalprice": (150000.0, 90000.0)})
    return out.select("o_orderkey", rnd("o_totalprice").alias("o_totalprice"))


@query("row_number_key_order", """SELECT o_orderpriority, o_orderkey,
  CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS BIGINT) AS row_id FROM orders""")
def _(spark, d):
    from onefold.operators.rowindex import dense_index

    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    out = dense_index(rows, ["o_orderpriority", "o_orderkey"])
    return out.withColumn("row_id", (F.col("row_id") + 1).cast("bigint"))


__all__ = ["ORACLES", "QUERIES"]
