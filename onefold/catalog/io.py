"""Registered queries: sources, sinks and stored models, each as a round trip of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from onefold.catalog.levels import EVENT_TOP, _picked_sql
from onefold.catalog.models import _WLSE, _wlse, cell_model
from onefold.catalog.tables import CELLS, rnd, table
from onefold.operators import levels as lv
from onefold.operators.chunkfit import fit_chunks
from onefold.operators.combine import coefficients, coefficients_wide, combine
from onefold.operators.compare import write_coefficients
from onefold.operators.stats import describe
from onefold.session import scratch_path, settle
from onefold.sources import csv, store

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, day string, o_orderpriority string"


def _orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")


@query("csv_roundtrip", """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders""")
def _(spark, d):
    path = scratch_path(spark, "orders")
    rows = _orders(spark, d).withColumn(
        "o_custkey", F.when(F.pmod("o_custkey", F.lit(10)) != 0, F.col("o_custkey")))
    csv.write_csv(rows, path)
    return csv.read_csv(spark, path, _ORDERS)


@query("csv_bad_lines", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 NOT IN (0, 1)""")
def _(spark, d):
    path = scratch_path(spark, "lines")
    digit = F.pmod("o_orderkey", F.lit(10))
    price = F.when(digit == 0, F.lit("oops")).otherwise(F.col("o_totalprice").cast("string"))
    extra = F.when(digit == 1, F.lit("one,field,more")).otherwise(F.col("o_orderpriority"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), price, extra)
    csv.write_text(table(spark, d, "orders").select(line.alias("line")), "line", path)
    return csv.read_csv_skip_bad(spark, path, "o_orderkey bigint, o_totalprice double, o_orderpriority string",
                                 ["o_orderkey", "o_totalprice"], header=False)


@query("csv_multi_file", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1")
def _(spark, d):
    rows = _orders(spark, d)
    root = scratch_path(spark, "years")
    paths = []
    for i in range(3):
        csv.write_csv(rows.filter(F.pmod("o_orderkey", F.lit(3)) == i), f"{root}/part{i}")
        paths.append(f"{root}/part{i}")
    return csv.read_csv(spark, paths, _ORDERS).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("price"))


@query("csv_header_concat", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, d):
    path = scratch_path(spark, "folder")
    csv.write_csv(_orders(spark, d), path, files=7)
    return csv.read_csv(spark, path, _ORDERS).select("o_orderkey", "o_orderpriority")


@query("csv_compressed_split", "SELECT CAST(21 AS BIGINT) AS files, count(*) AS n, sum(o_custkey)::BIGINT AS customers FROM orders")
def _(spark, d):
    path = scratch_path(spark, "bz2")
    csv.write_csv(_orders(spark, d), path, files=21, compression="bzip2")
    rows = csv.read_csv(spark, path, _ORDERS).withColumn("file", F.input_file_name())
    by_file = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("c"))
    return by_file.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("n"), F.sum("c").alias("customers"))


@query("csv_extract_gzip", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_returnflag, l_linestatus FROM lineitem")
def _(spark, d):
    path = scratch_path(spark, "extract")
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"]
    csv.write_extract(table(spark, d, "lineitem"), columns, path)
    return csv.read_csv(spark, path, (
        "l_orderkey bigint, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string"))


_LINES = "sum(length(text) - length(replace(text, chr(10), '')) + 1)"


@query("text_line_count", f"SELECT CAST({_LINES} AS BIGINT) AS n FROM documents")
def _(spark, d):
    path = scratch_path(spark, "lines")
    csv.write_text(table(spark, d, "documents"), "text", path)
    return csv.read_lines(spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("whole_text_files", f"SELECT CAST({_LINES} AS BIGINT) AS lines, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents")
def _(spark, d):
    path = scratch_path(spark, "whole")
    docs = table(spark, d, "documents")
    # A file is read as one string: files are set by volume, about 4 MB each.
    volume = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    csv.write_text(docs.repartition(1 + volume // 4_000_000, "doc_id"), "text", path)
    text = F.col("text")
    per_file = csv.read_whole_files(spark, path).select(
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"),
        F.length(text).alias("chars"))
    return per_file.agg(F.sum("lines").cast("bigint").alias("lines"), F.sum("chars").alias("chars"))


@query("stats_roundtrip", " UNION ALL ".join(
    f"SELECT '{c}' AS col, count({c}) AS n, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS sd, "
    f"min({c}) AS min, max({c}) AS max FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax"]))
def _(spark, d):
    path = scratch_path(spark, "stats")
    store.save_stats_csv(describe(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), path)
    return store.load_stats_csv(spark, path).withColumns({"mean": rnd("mean", 8), "sd": rnd("sd", 8)})


@query("levels_roundtrip", f"WITH {_picked_sql('events', EVENT_TOP)} SELECT factor, level, n, code, term FROM terms")
def _(spark, d):
    path = scratch_path(spark, "model")
    counts = lv.level_counts(table(spark, d, "events"), list(EVENT_TOP))
    store.save_table(lv.term_levels(lv.select_levels(counts, EVENT_TOP)), path, "levels")
    return store.load_table(spark, path, "levels")


@query("level_select_from_file", f"""WITH {_picked_sql('orders', {'o_orderpriority': 0.7, 'o_custkey': 0.5})}
SELECT factor, level, n, kept FROM picked""")
def _(spark, d):
    path = scratch_path(spark, "orders")
    csv.write_csv(_orders(spark, d), path, files=5)
    out = lv.select_levels_from_files(spark, path, _ORDERS, ["o_orderpriority", "o_custkey"],
                                      {"o_orderpriority": 0.7, "o_custkey": 0.5})
    return out.select("factor", "level", "n", "kept")


@query("model_roundtrip", _WLSE)
def _(spark, d):
    # Summaries and term list are stored, read back, and combined from the stored tables.
    rows, spec = cell_model(spark, d)
    path = scratch_path(spark, "model")
    store.save_model(path, spec, summary=fit_chunks(rows.filter(F.col("partition_id") < 2), spec))
    store.append_summary(fit_chunks(rows.filter(F.col("partition_id") >= 2), spec), path)
    loaded = store.load_spec(spark, path)
    combined = settle(combine(store.load_table(spark, path, "summary"), loaded))
    return _wlse(combined, loaded)


@query("coef_csv", f"WITH {CELLS} SELECT term, round(one_shot, 8) + 0.0 AS one_shot, round(b, 8) + 0.0 AS wlse FROM wl")
def _(spark, d):
    rows, spec = cell_model(spark, d)
    combined = combine(fit_chunks(rows, spec), spec)
    wide = coefficients_wide(coefficients(combined, spec, {"wlse": "wlse", "one_shot": "one_shot"}), spec,
                             ["one_shot", "wlse"])
    path = scratch_path(spark, "coef")
    write_coefficients(wide.withColumns({c: rnd(c, 8) for c in ("wlse", "one_shot")}), path)
    return csv.read_csv(spark, path, "term string, one_shot double, wlse double")


__all__ = ["ORACLES", "QUERIES"]
