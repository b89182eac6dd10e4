"""What the physical plans look like: pushdown, pruning, shuffles, joins."""

import pytest
from pyspark.sql import functions as F

from onefold.catalog.tables import shipments, table
from onefold.operators import levels as lv
from onefold.operators import stats as st
from onefold.operators.chunkfit import fit_chunks, fit_in_place
from onefold.operators.chunks import bucketed
from onefold.operators.combine import combine
from onefold.operators.evaluate import constants, loglik
from onefold.operators.prepare import collapse_levels, project
from onefold.spec import Factor, TermSpec

SPEC = TermSpec("late", ("l_quantity",), (Factor.build("l_linestatus", ["F", "O"], "first"),), True)
CELLS = TermSpec("late", (), (Factor.build("l_linestatus", ["F", "O"]),))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def line(spark, sf_dir):
    late = F.when(F.col("l_tax") > 0.04, 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").withColumn("late", late).withColumn(
        "partition_id", F.pmod("l_orderkey", F.lit(4)).cast("bigint"))


def test_projection_and_null_filter_reach_the_scan(spark, sf_dir):
    plan = plan_of(project(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan
    assert "IsNotNull(l_quantity)" in plan and "IsNotNull(l_tax)" in plan


def test_fit_reads_only_what_it_uses(line):
    plan = plan_of(fit_chunks(line, SPEC, pool=False))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_tax:double,l_linestatus:string>" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_factor_only_fit_adds_up_before_the_shuffle(line):
    plan = plan_of(fit_chunks(line, CELLS, pool=False))
    below = plan[plan.rindex("Exchange"):]
    assert "HashAggregate" in below and "partial_sum" in below


def test_fit_in_place_shuffles_nothing(line):
    assert "Exchange" not in plan_of(fit_in_place(line, SPEC, fallback=False))


def test_a_bucketed_chunk_table_is_fitted_without_a_shuffle(line, spark):
    rows = bucketed(line.select("partition_id", *[c for c in line.columns if c != "partition_id"]), ["partition_id"], 4)
    plan = plan_of(fit_chunks(rows, SPEC, compress=False, rows_per_task=None, pool=False))
    assert "Exchange" not in plan and "FlatMapGroupsInPandas" in plan
    counts = plan_of(rows.groupBy("partition_id", "l_linestatus").count())
    assert "Exchange" not in counts
    assert rows.count() == line.count()


def test_chunks_of_few_predictor_rows_are_added_up_in_their_buckets(line, spark, monkeypatch):
    # The chunk table query holds a row per chunk and level in Python, however many rows a chunk has.
    rows = bucketed(line.select("partition_id", *[c for c in line.columns if c != "partition_id"]), ["partition_id"], 4)
    plan = plan_of(fit_chunks(rows, CELLS, pool=False))
    assert "Exchange" not in plan and "FlatMapGroupsInPandas" in plan
    assert "HashAggregate" in plan[plan.index("FlatMapGroupsInPandas"):]
    from onefold.catalog import large

    plans = []

    def seen(*args, **kw):
        plans.append(plan_of(fit_chunks(*args, **{**kw, "pool": False})))
        return fit_chunks(*args, **kw)

    monkeypatch.setattr(large, "fit_chunks", seen)
    assert large.QUERIES["chunk_table_bucketed"](spark, "/root/testdata/sf0.01").count() == 10
    assert "Exchange" not in plans[0] and "HashAggregate" in plans[0]


def test_combine_shuffles_partial_sums(line):
    plan = plan_of(combine(fit_chunks(line, SPEC, pool=False), SPEC))
    below = plan[:plan.index("FlatMapGroupsInPandas")]
    assert "partial_sum" in below and "Join" not in below


def test_loglik_is_one_scan_and_one_small_exchange(spark, line):
    betas = constants({"a": [0.1, 0.2, 0.3], "b": [0.0, 0.0, 0.1]}, spark)
    plan = plan_of(loglik(line, SPEC, betas, ["a", "b"]))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Python" not in plan
    assert "Exchange SinglePartition" in plan and "partial_sum" in plan


def test_level_counts_combine_before_the_shuffle(spark, sf_dir):
    plan = plan_of(lv.level_counts(table(spark, sf_dir, "events"), ["event_type", "user_id"]))
    assert "partial_count" in plan and "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def test_group_means_use_no_window(spark, sf_dir):
    plan = plan_of(st.centre_in_group(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity"))
    assert "Window" not in plan and "partial_avg" in plan


def test_kept_levels_are_broadcast_only_when_few(spark, sf_dir, monkeypatch):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    picked = lv.select_levels(lv.level_counts(events, ["event_type"]), {"event_type": 0.7})
    assert "BroadcastHashJoin" in plan_of(collapse_levels(events, picked, ["event_type"]))
    from onefold import session
    from onefold.operators import prepare

    monkeypatch.setattr(prepare, "small_side", lambda df: session.small_side(df, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(collapse_levels(events, picked, ["event_type"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shipments_prunes_both_sides(spark, sf_dir):
    plan = plan_of(shipments(spark, sf_dir).select("cell", "late"))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
