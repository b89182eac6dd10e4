"""Frames and SQL fragments that several registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.operators import levels as lv
from onefold.spec import TermSpec

# Columns that tell lineitem rows apart.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order: two 0/1 responses, factor columns and a chunk number."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    gap = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        *LINE_KEY, "l_discount", "l_tax", "l_linestatus", "l_returnflag", "o_orderpriority", "o_custkey",
        F.when(gap > 60, 1).otherwise(0).alias("late"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"),
        F.concat_ws("|", "o_orderpriority", "l_linestatus").alias("cell"),
        F.pmod("l_orderkey", F.lit(4)).cast("bigint").alias("partition_id"),
    )


SHIP = """ship AS (
  SELECT l.*, o_orderpriority, o_custkey,
         CASE WHEN date_diff('day', o_orderdate, l_shipdate) > 60 THEN 1 ELSE 0 END AS late,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
         o_orderpriority || '|' || l_linestatus AS cell,
         l_orderkey % 4 AS partition_id
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"""

# Closed form of a chunk fit with one factor and no intercept.
CELLS = f"""{SHIP}, counts AS (
  SELECT partition_id, cell, CAST(count(*) AS DOUBLE) AS n, CAST(sum(late) AS DOUBLE) AS y
  FROM ship GROUP BY partition_id, cell), fits AS (
  SELECT partition_id, cell, n, y, ln(y / (n - y)) AS theta, y * (n - y) / n AS h FROM counts), wl AS (
  SELECT 'cell_' || cell AS term, sum(h * theta) / sum(h) AS b, avg(theta) AS one_shot,
         sum(h) AS h, sum(n) AS n, sum(y) AS y
  FROM fits GROUP BY cell)"""

# Closed form of the shrinkage path when the Hessian is diagonal.
PATH = f"""{CELLS}, c AS (SELECT *, h * b * b AS c FROM wl), lam AS (
  SELECT cutoff, CAST(row_number() OVER (ORDER BY cutoff DESC) - 1 AS INTEGER) AS step
  FROM (SELECT c AS cutoff FROM c UNION ALL SELECT 0.0)), steps AS (
  SELECT step, term, b * greatest(0.0, 1.0 - cutoff / c) AS beta, c, cutoff FROM lam, c), fit AS (
  SELECT step, sum(c * least(1.0, cutoff / c) * least(1.0, cutoff / c)) AS rss,
         CAST(sum(CASE WHEN c > cutoff THEN 1 ELSE 0 END) AS INTEGER) AS dof
  FROM steps GROUP BY step), total AS (SELECT sum(n) AS n FROM wl), scored AS (
  SELECT step, rss, dof, rss + 2 * dof AS aic, rss + ln(n) * dof AS bic FROM fit, total)"""


def factor_spec(df: DataFrame, response: str, factors: list[str], **kw) -> TermSpec:
    """All levels of the given factors, read from the data."""
    picked = lv.select_levels(lv.level_counts(df, factors), {f: 1.0 for f in factors})
    return TermSpec.from_levels(lv.term_levels(picked), response, factors=factors, **kw)
