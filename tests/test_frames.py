"""Row preparation, levels, row numbers, sources and stored tables against brute force."""

import collections

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from onefold.operators import chunks as ch
from onefold.operators import levels as lv
from onefold.operators import stats as st
from onefold.operators.chunkfit import fit_chunks
from onefold.operators.combine import combine
from onefold.operators.ols import group_ols
from onefold.operators.prepare import add_codes, add_level_codes, collapse_levels, dummy_columns, project
from onefold.operators.rowindex import dense_index
from onefold.sources import csv
from onefold.sources.rows import from_local, generate_groups
from onefold.spec import OTHERS, Factor, TermSpec
from onefold.streaming.arrivals import stored_summaries, stream_summaries


def skewed(n=2000, seed=0):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 400, n).astype(str))
    return pd.DataFrame({"a": a, "b": rng.choice([1, 2, 3], n, p=[0.7, 0.2, 0.1])})


def brute_levels(values, keep, min_share=None):
    counts = collections.Counter(map(str, values))
    total, run, out = sum(counts.values()), 0, {}
    for level, n in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])):
        run += n
        out[level] = (n, run, run / total <= keep or (min_share is not None and n >= min_share * total))
    return out


@pytest.mark.parametrize("min_share", [None, 0.1])
@pytest.mark.parametrize("window", [1, 1_000_000])
def test_level_selection(spark, min_share, window):
    pdf = skewed()
    counts = lv.level_counts(spark.createDataFrame(pdf), ["a", "b"])
    got = lv.select_levels(counts, {"a": 0.3, "b": 0.9}, min_share, window_levels=window).collect()
    for f, keep in (("a", 0.3), ("b", 0.9)):
        own = {r["level"]: (r["n"], r["cum_n"], r["kept"]) for r in got if r["factor"] == f}
        assert own == brute_levels(pdf[f], keep, min_share)
        ranks = sorted(r["rank"] for r in got if r["factor"] == f)
        assert ranks == list(range(1, len(own) + 1))


def test_strict_rule_drops_a_dominant_level_and_share_rule_keeps_it(spark):
    pdf = skewed()
    counts = lv.level_counts(spark.createDataFrame(pdf), ["a"])
    strict = lv.select_levels(counts, {"a": 0.3}).filter("kept and level = 'hot'")
    share = lv.select_levels(counts, {"a": 0.3}, 0.1).filter("kept and level = 'hot'")
    assert strict.isEmpty() and share.count() == 1


def test_codes_follow_frequency_after_collapsing(spark):
    pdf = skewed()
    terms = lv.term_levels(lv.select_levels(lv.level_counts(spark.createDataFrame(pdf), ["a"]), {"a": 0.5}))
    rows = sorted(terms.collect(), key=lambda r: r["code"])
    assert [r["code"] for r in rows] == list(range(len(rows)))
    assert [r["n"] for r in rows] == sorted((r["n"] for r in rows), reverse=True)
    assert sum(r["n"] for r in rows) == len(pdf)
    assert OTHERS in [r["level"] for r in rows]


def test_collapse_join_equals_literal_list(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    picked = lv.select_levels(lv.level_counts(df, ["a"]), {"a": 0.5}, 0.1)
    spec = TermSpec.from_levels(lv.term_levels(picked), "y", factors=["a"])
    joined = collapse_levels(df, picked, ["a"]).groupBy("a").count().collect()
    coded = add_codes(df, spec).groupBy("code_a").count().collect()
    slots = spec.factors[0].slots
    assert {r["a"]: r["count"] for r in joined} == {slots[r["code_a"]]: r["count"] for r in coded}


@pytest.mark.parametrize("baseline", ["none", "first", "last", "l3"])
@pytest.mark.parametrize("width", [5, 40])
def test_codes_match_dummies(spark, baseline, width):
    """Below and above the size where codes come from a join; unseen levels included."""
    levels = [f"l{i}" for i in range(width)]
    spec = TermSpec("y", (), (Factor.build("f", levels, baseline),))
    values = levels * 3 + ["unseen"]
    df = spark.createDataFrame(pd.DataFrame({"f": values, "y": 0}))
    rows = add_codes(dummy_columns(df, spec), spec).collect()
    assert len(rows) == len(values)
    for r in rows:
        hot = [t for t in spec.terms if r[t] == 1]
        code = r["code_f"]
        assert (code is None) == (r["f"] == "unseen") == (r[spec.terms[0]] is None)
        assert hot == ([spec.terms[code]] if code is not None and code < len(spec.terms) else [])


@pytest.mark.parametrize("window", [1, 1_000_000])
def test_codes_of_more_levels_than_a_term_list_holds(spark, window):
    users = [str(u) for u in range(2500) for _ in range(1 + u % 2)] + [None]
    pdf = pd.DataFrame({"a": users, "b": ["x" if i % 3 else "y" for i in range(len(users))]})
    df = spark.createDataFrame(pdf)
    picked = lv.select_levels(lv.level_counts(df, ["a", "b"]), {"a": 0.9, "b": 1.0})
    slots = lv.level_slots(lv.term_levels(picked), window).persist()
    got = add_level_codes(df, slots, ["a", "b"]).collect()
    kept = {level for level, (_, _, ok) in brute_levels(users[:-1], 0.9).items() if ok}
    assert len(kept) > 2000
    at = {level: i for i, level in enumerate(sorted([*kept, OTHERS]))}
    for r in got:
        assert r["code_a"] == (None if r["a"] is None else at.get(r["a"], at[OTHERS]))
        assert r["code_b"] == "xy".index(r["b"])


def test_the_code_query_takes_any_number_of_users(spark, tmp_path):
    import __spark_entry__ as entry

    events = spark.range(9000).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), (F.col("id") % 3000).alias("user_id"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    out = entry.queries()["factor_codes"](spark, str(tmp_path))
    assert out.count() == 9000 and out.select("code_user_id").distinct().count() == 2401


def test_missing_values_go_like_dropna(spark):
    rows = [(1.0, "a"), (None, "b"), (float("nan"), "c"), (2.0, None), (3.0, "NaN")]
    df = spark.createDataFrame(rows, "x double, s string")
    got = project(df, ["x", "s"])
    assert sorted(r["x"] for r in got.collect()) == [1.0, 3.0]
    assert got.exceptAll(df.dropna()).isEmpty() and df.dropna().exceptAll(got).isEmpty()


def test_too_many_terms_is_an_error(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": np.arange(200).astype(str)}))
    terms = lv.term_levels(lv.select_levels(lv.level_counts(df, ["a"]), {"a": 1.0}))
    with pytest.raises(ValueError):
        TermSpec.from_levels(terms, "y", factors=["a"], max_terms=100)


def test_row_numbers_with_copies(spark):
    pdf = pd.DataFrame({"k": [5] * 700 + list(range(1000))})
    got = dense_index(spark.createDataFrame(pdf).repartition(5), ["k"], parts=6).toPandas()
    got = got.sort_values("row_id")
    assert got["row_id"].tolist() == list(range(1700))
    assert got["k"].tolist() == sorted(pdf["k"])


@pytest.mark.parametrize("n,k", [(100, 7), (5, 8), (21, 21)])
def test_split_even_has_ntile_sizes(spark, n, k):
    got = ch.split_even(spark.range(n), ["id"], k).toPandas().sort_values("id")["slice"].tolist()
    sizes = [n // k + (i < n % k) for i in range(k)]
    assert got == [i + 1 for i, s in enumerate(sizes) for _ in range(s)]


def test_planned_chunks_are_bounded_for_a_hot_model(spark):
    df = spark.range(30_000).withColumn("m", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("m"), (F.col("id") % 50).cast("string"))))
    plan = ch.chunk_plan(df, 500, ["m"])
    assert plan.filter("m = 'hot'").first()["chunks"] == 20
    out = ch.chunk_by_plan(df, plan, ["id"], ["m"])
    assert out.count() == 30_000
    assert out.groupBy("m", "partition_id").count().agg(F.max("count")).first()[0] < 700
    again = ch.chunk_by_plan(df.repartition(9), plan, ["id"], ["m"])
    assert out.exceptAll(again).isEmpty()


def test_shuffle_keeps_all_rows(spark):
    df = spark.range(1000)
    got = [r["id"] for r in ch.shuffle_rows(df, 3).collect()]
    assert sorted(got) == list(range(1000)) and got != list(range(1000))
    parts = ch.split_random(df, 4, 9)
    assert sum(p.count() for p in parts) == 1000


def test_group_helpers_keep_null_groups(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (2, 5.0), (2, 10.0), (None, 4.0)], "id int, v double")
    got = sorted((r["v"], r["centred"]) for r in st.centre_in_group(df, "id", "v").collect())
    assert got == [(1.0, -0.5), (2.0, 0.5), (3.0, -3.0), (4.0, 0.0), (5.0, -1.0), (10.0, 4.0)]
    z = {r["v"]: r["zscore"] for r in st.zscore_in_group(df, "id", "v").collect()}
    assert z[4.0] is None and z[1.0] == pytest.approx(-0.5 / np.sqrt(0.5))


def test_describe_is_typed(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, None), (6.0, 7)], "a double, b int")
    got = {r["col"]: r for r in st.describe(df, ["a", "b"]).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["min"], got["a"]["max"]) == (3, 3.0, 1.0, 6.0)
    assert got["b"]["n"] == 2 and got["a"]["sd"] == pytest.approx(np.std([1, 2, 6], ddof=1))


def test_group_ols_against_least_squares(spark):
    df = generate_groups(spark, 4000, 1000, seed=2)
    pdf = df.toPandas()
    got = {r["id"]: r for r in group_ols(df, "id", "y", ["x1", "x2"]).collect()}
    assert set(got) == {0, 1, 2, 3}
    for g, part in pdf.groupby("id"):
        x = np.column_stack([np.ones(len(part)), part.x1, part.x2])
        b = np.linalg.lstsq(x, part.y, rcond=None)[0]
        np.testing.assert_allclose([got[g]["intercept"], got[g]["x1"], got[g]["x2"]], b, atol=1e-9)


def test_group_ols_with_a_constant_regressor(spark):
    pdf = pd.DataFrame({"id": 1, "x1": [1.0, 2, 3, 4], "x2": 5.0, "y": [2.0, 4, 6, 8]})
    r = group_ols(spark.createDataFrame(pdf), "id", "y", ["x1", "x2"]).first()
    assert r["x1"] == pytest.approx(2) and r["x2"] == pytest.approx(0) and r["intercept"] == pytest.approx(0)


def test_bad_lines_do_not_depend_on_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,x\n1,oops,x\n3,NA,y\n4,5\n6,7,z,9\n")
    schema = "a int, b double, c string"
    full = csv.read_csv_skip_bad(spark, str(tmp_path), schema)
    assert sorted(r["a"] for r in full.collect()) == [1, 3]
    assert csv.read_csv_skip_bad(spark, str(tmp_path), schema, ["c"]).count() == 2


def test_files_are_compressed_with_headers(spark, tmp_path):
    df = spark.range(100).withColumn("s", F.lit("v"))
    csv.write_csv(df, str(tmp_path / "o"), files=4, compression="bzip2")
    files = list((tmp_path / "o").glob("*.bz2"))
    assert len(files) == 4
    assert csv.read_csv(spark, [str(f) for f in files], "id bigint, s string").count() == 100


def test_local_rows_in_slices(spark):
    pdf = pd.DataFrame({"a": range(10)})
    assert sorted(r["a"] for r in from_local(spark, pdf, slices=3).collect()) == list(range(10))


def test_stream_extends_the_summary(spark, tmp_path):
    """Files that arrive later are fitted alone; the combined estimate covers all of them."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"x": rng.normal(size=900), "partition_id": np.arange(900) % 6})
    pdf["y"] = (rng.random(900) < 1 / (1 + np.exp(-pdf.x))).astype(int)
    spec = TermSpec("y", ("x",), (), True)
    inbox, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    early, late = pdf[pdf.partition_id < 3], pdf[pdf.partition_id >= 3]
    for part in (early, late):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("x double, partition_id bigint, y bigint").parquet(inbox)
        query = stream_summaries(stream, spec, out, state, lambda batch: batch)
        query.awaitTermination(120)
        query.stop()
    stored = stored_summaries(spark, out)
    assert stored.count() == 6 and stored.select("batch").distinct().count() == 2
    whole = combine(fit_chunks(spark.createDataFrame(pdf), spec), spec).first()
    np.testing.assert_allclose(combine(stored, spec).first()["wlse"], whole["wlse"], atol=1e-9)
