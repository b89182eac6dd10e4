"""Registered queries: level dictionaries, collapsing, one-hot columns and vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from onefold.catalog.tables import SHIP, factor_spec, rnd, shipments, table
from onefold.operators import levels as lv
from onefold.operators.prepare import add_level_codes, clean, collapse_levels, design_columns, dummy_columns, level_terms
from onefold.operators.stats import describe
from onefold.plans import ml
from onefold.session import settle
from onefold.spec import TermSpec

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


EVENT_TOP = {"event_type": 0.7, "user_id": 0.8}
PART_TOP = {"p_type": 0.5, "p_brand": 0.8}


def _counts_sql(source: str, factors) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS level, count(*) AS n FROM {source} GROUP BY {f}"
        for f in factors)


def _picked_sql(source: str, top: dict[str, float], min_share: float | None = None) -> str:
    """CTEs ``counts`` and ``picked`` (the level dictionary)."""
    share = " ".join(f"WHEN '{f}' THEN CAST({v} AS DOUBLE)" for f, v in top.items())
    extra = f" OR CAST(n AS DOUBLE) >= CAST({min_share} AS DOUBLE) * CAST(total AS DOUBLE)" if min_share else ""
    return f"""counts AS ({_counts_sql(source, top)}), ranked AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY factor) AS BIGINT) AS total,
    CAST(sum(n) OVER (PARTITION BY factor ORDER BY n DESC, level ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n,
    CAST(row_number() OVER (PARTITION BY factor ORDER BY n DESC, level) AS INTEGER) AS rank FROM counts), shared AS (
  SELECT *, CAST(cum_n AS DOUBLE) / CAST(total AS DOUBLE) AS cum_frac FROM ranked), picked AS (
  SELECT *, (cum_frac <= CASE factor {share} END){extra} AS kept FROM shared), collapsed AS (
  SELECT factor, CASE WHEN kept THEN level ELSE '000_OTHERS' END AS level, CAST(sum(n) AS BIGINT) AS n
  FROM picked GROUP BY 1, 2), terms AS (
  SELECT factor, level, n, CAST(row_number() OVER (PARTITION BY factor ORDER BY n DESC, level) - 1 AS INTEGER) AS code,
    factor || '_' || level AS term FROM collapsed)"""


_DICT = "SELECT factor, level, n, total, rank, cum_n, round(cum_frac, 9) AS cum_frac, kept FROM picked"


def _dictionary(levels):
    return levels.select("factor", "level", "n", "total", "rank", F.col("cum_n"),
                         rnd("cum_frac", 9).alias("cum_frac"), "kept")


@query("level_counts", _counts_sql("events", EVENT_TOP))
def _(spark, d):
    return lv.level_counts(table(spark, d, "events"), list(EVENT_TOP))


@query("level_counts_merged", _counts_sql("events", EVENT_TOP))
def _(spark, d):
    rows = table(spark, d, "events")
    slices = [rows.filter(F.pmod("event_id", F.lit(3)) == i) for i in range(3)]
    return lv.merge_counts(*[lv.level_counts(s, list(EVENT_TOP)) for s in slices])


@query("level_select_strict", f"WITH {_picked_sql('events', EVENT_TOP)} {_DICT}")
def _(spark, d):
    counts = lv.level_counts(table(spark, d, "events"), list(EVENT_TOP))
    return _dictionary(lv.select_levels(counts, EVENT_TOP))


@query("level_select_10pct", f"WITH {_picked_sql('part', PART_TOP, 0.1)} {_DICT}")
def _(spark, d):
    counts = lv.level_counts(table(spark, d, "part"), list(PART_TOP))
    return _dictionary(lv.select_levels(counts, PART_TOP, min_share=0.1))


@query("level_select_ranges", f"WITH {_picked_sql('events', EVENT_TOP)} {_DICT}")
def _(spark, d):
    # The way for factors with very many levels: ranges instead of one window task per factor.
    counts = lv.level_counts(table(spark, d, "events"), list(EVENT_TOP))
    return _dictionary(lv.select_levels(counts, EVENT_TOP, window_levels=1))


@query("running_share", f"WITH {_picked_sql('part', PART_TOP)} SELECT factor, level, n, cum_n, rank FROM ranked")
def _(spark, d):
    counts = lv.level_counts(table(spark, d, "part"), list(PART_TOP))
    return lv.rank_levels(counts).select("factor", "level", "n", "cum_n", "rank")


@query("level_codes", f"WITH {_picked_sql('events', EVENT_TOP)} SELECT factor, level, n, code, term FROM terms")
def _(spark, d):
    counts = lv.level_counts(table(spark, d, "events"), list(EVENT_TOP))
    return lv.term_levels(lv.select_levels(counts, EVENT_TOP))


@query("dropped_levels", f"WITH {_picked_sql('events', EVENT_TOP)} SELECT factor, level, n FROM counts EXCEPT "
       "SELECT factor, level, n FROM picked WHERE kept")
def _(spark, d):
    counts = lv.level_counts(table(spark, d, "events"), list(EVENT_TOP))
    return lv.dropped_levels(lv.select_levels(counts, EVENT_TOP))


@query("topn_levels", "SELECT 'p_brand' AS factor, p_brand AS level, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, level LIMIT 10")
def _(spark, d):
    return lv.top_levels(lv.level_counts(table(spark, d, "part"), ["p_brand"]), "p_brand", 10)


@query("extend_levels", f"""WITH {_picked_sql('part', PART_TOP)} SELECT factor, level, n, code, term FROM terms UNION ALL
SELECT 'year', CAST(y AS VARCHAR), NULL, CAST(y - 1987 AS INTEGER), 'year_' || y FROM range(1987, 2009) r(y)""")
def _(spark, d):
    terms = lv.term_levels(lv.select_levels(lv.level_counts(table(spark, d, "part"), list(PART_TOP)), PART_TOP))
    return lv.extend_levels(terms, "year", 1987, 2008)


_COLLAPSED = f"""WITH {_picked_sql('events', EVENT_TOP)}
SELECT event_id, CASE WHEN t.kept THEN event_type ELSE '000_OTHERS' END AS event_type,
  CASE WHEN u.kept THEN CAST(user_id AS VARCHAR) ELSE '000_OTHERS' END AS user_id FROM events
JOIN picked t ON t.factor = 'event_type' AND t.level = event_type
JOIN picked u ON u.factor = 'user_id' AND u.level = CAST(user_id AS VARCHAR)"""


@query("collapse_levels", _COLLAPSED)
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id")
    picked = settle(lv.select_levels(lv.level_counts(rows, list(EVENT_TOP)), EVENT_TOP))
    return collapse_levels(rows, picked, list(EVENT_TOP))


@query("factor_codes", f"""WITH {_picked_sql('events', EVENT_TOP)}, slots AS (
  SELECT factor, level, CAST(row_number() OVER (PARTITION BY factor ORDER BY level) - 1 AS INTEGER) AS slot FROM terms),
c AS ({_COLLAPSED[_COLLAPSED.index('SELECT event_id'):]})
SELECT event_id, t.slot AS code_event_type, u.slot AS code_user_id FROM c
JOIN slots t ON t.factor = 'event_type' AND t.level = event_type
JOIN slots u ON u.factor = 'user_id' AND u.level = user_id""")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id")
    picked = lv.select_levels(lv.level_counts(rows, list(EVENT_TOP)), EVENT_TOP)
    # Users grow with the events, so their codes are a joined frame and no term list on the driver.
    slots = settle(lv.level_slots(lv.term_levels(picked)))
    return add_level_codes(rows, slots, list(EVENT_TOP)).select("event_id", "code_event_type", "code_user_id")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _part_spec(spark, d, baseline="none") -> TermSpec:
    return factor_spec(table(spark, d, "part"), "p_size", ["p_type"], baseline=baseline)


@query("onehot_columns", "SELECT p_partkey, " + ", ".join(
    f"CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END AS p_type_{t}" for t in TYPES) + " FROM part")
def _(spark, d):
    spec = _part_spec(spark, d)
    return dummy_columns(table(spark, d, "part"), spec).select("p_partkey", *spec.terms)


@query("drop_baseline", "SELECT p_partkey, " + ", ".join(
    f"CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END AS p_type_{t}" for t in TYPES[1:]) + " FROM part")
def _(spark, d):
    spec = _part_spec(spark, d, baseline="first")
    return dummy_columns(table(spark, d, "part"), spec).select("p_partkey", *spec.terms)


@query("baseline_rules", """WITH c AS (SELECT p_type AS level, count(*) AS n FROM part GROUP BY 1)
SELECT 'first' AS rule, (SELECT min(level) FROM c) AS level UNION ALL
SELECT 'last', (SELECT level FROM c ORDER BY n, level DESC LIMIT 1) UNION ALL SELECT 'explicit', 'PROMO'""")
def _(spark, d):
    levels = settle(lv.term_levels(
        lv.select_levels(lv.level_counts(table(spark, d, "part"), ["p_type"]), {"p_type": 1.0})))
    chosen = [
        (rule, TermSpec.from_levels(levels, "p_size", factors=["p_type"], baseline=given).factors[0].baseline)
        for rule, given in (("first", "first"), ("last", "last"), ("explicit", "PROMO"))
    ]
    return spark.createDataFrame(chosen, "rule string, level string")


@query("onehot_vector", """WITH c AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1)
SELECT p_partkey, """ + ", ".join(f"CASE WHEN r = {i + 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h{i}" for i in range(6)) +
       " FROM part JOIN c USING (p_type)")
def _(spark, d):
    spec = _part_spec(spark, d)
    out, _ = ml.onehot(table(spark, d, "part").select("p_partkey", "p_type"), spec)
    return out.select("p_partkey", *[F.col("features_ONEHOT")[i].alias(f"h{i}") for i in range(6)])


@query("onehot_drop_last", """WITH c AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1)
SELECT p_partkey, CAST(5 AS INTEGER) AS width, CASE WHEN r = 6 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS total
FROM part JOIN c USING (p_type)""")
def _(spark, d):
    spec = _part_spec(spark, d)
    out, _ = ml.onehot(table(spark, d, "part").select("p_partkey", "p_type"), spec, drop_last=True)
    hot = F.col("features_ONEHOT")
    return out.select("p_partkey", F.size(hot).alias("width"),
                      F.aggregate(hot, F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("scaler_vector", """WITH s AS (SELECT avg(p_size) AS m, stddev_samp(p_size) AS sd, avg(p_retailprice) AS mp,
  stddev_samp(p_retailprice) AS sp FROM part)
SELECT p_partkey, round((p_retailprice - mp) / sp, 6) + 0.0 AS price, round((p_size - m) / sd, 6) + 0.0 AS size FROM part, s""")
def _(spark, d):
    rows = table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    out = ml.scaled(rows, ["p_retailprice", "p_size"]).withColumn("a", vector_to_array("features_x_std"))
    return out.select("p_partkey", rnd(F.col("a")[0]).alias("price"), rnd(F.col("a")[1]).alias("size"))


_DESIGN = """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN 1 ELSE 0 END AS l_tax{intercept},
  round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity,
  CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS l_returnflag_N,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS l_returnflag_R FROM lineitem, s"""


def _line_spec(spark, d, intercept: bool) -> TermSpec:
    line = table(spark, d, "lineitem")
    base = factor_spec(line, "l_tax", ["l_returnflag"], continuous=["l_quantity"], baseline="first",
                       intercept=intercept)
    return base.with_scales(describe(line, ["l_quantity"]))


@query("design_matrix", _DESIGN.format(intercept=", 1.0::DOUBLE AS intercept"))
def _(spark, d):
    spec = _line_spec(spark, d, True)
    rows = table(spark, d, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") > 0, 1).otherwise(0))
    return design_columns(rows, spec, ["l_orderkey", "l_linenumber"]).withColumn(
        "l_quantity", rnd("l_quantity"))


@query("clean_job", _DESIGN.format(intercept=""))
def _(spark, d):
    spec = _line_spec(spark, d, False)
    return clean(table(spark, d, "lineitem"), spec, ["l_orderkey", "l_linenumber"]).withColumn(
        "l_quantity", rnd("l_quantity"))


@query("term_order", "SELECT CAST(row_number() OVER (ORDER BY grp, term) - 1 AS INTEGER) AS pos, term FROM ("
       "SELECT 0 AS grp, 'intercept' AS term UNION ALL SELECT 1, 'l_quantity' UNION ALL "
       "SELECT DISTINCT 2, 'l_returnflag_' || l_returnflag FROM lineitem WHERE l_returnflag <> 'A')")
def _(spark, d):
    terms = _line_spec(spark, d, True).terms
    return spark.createDataFrame(list(enumerate(terms)), "pos int, term string")


@query("level_terms", f"WITH {SHIP} SELECT term, count(*) AS n FROM (SELECT 'o_orderpriority_' || o_orderpriority AS term FROM ship) GROUP BY 1")
def _(spark, d):
    return level_terms(shipments(spark, d), "o_orderpriority").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["ORACLES", "QUERIES"]
