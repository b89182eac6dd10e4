"""Heavy levels, QR trees, penalised paths, permutations and merged statistics against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from onefold.operators import levels as lv
from onefold.operators.heavy import merge_sketches, select_heavy_levels, sketch_levels
from onefold.operators.penalised import minimise, penalised_path
from onefold.operators.permute import permuted, random_index
from onefold.operators.qr import group_ols_qr, tall_qr
from onefold.operators.stats import describe, merge_quantiles, merge_stats, quantile_sketches, quantiles
from onefold.plans import ml
from onefold.spec import OTHERS, TermSpec


def kept(levels):
    return sorted(tuple(r) for r in levels.filter("kept").select("factor", "level", "n", "rank", "cum_n").collect())


@pytest.mark.parametrize(("candidates", "buckets"), [(2, 1), (4, 8), (16, 64), (500, 1024)])
@pytest.mark.parametrize("min_share", [None, 0.02])
def test_heavy_levels_equal_a_full_count(spark, candidates, buckets, min_share):
    """Long tails, ties and nulls; candidates and buckets so few that the proof must recount."""
    rng = np.random.default_rng(candidates)
    pdf = pd.DataFrame({"a": [f"v{int(x)}" for x in rng.pareto(0.8, 4000)], "b": [f"t{i % 97}" for i in range(4000)]})
    pdf.loc[::50, "a"] = None
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("a") != "None", F.col("a")))
    top = {"a": 0.6, "b": 0.5}
    want = lv.select_levels(lv.level_counts(df, list(top)), top, min_share)
    sketches = merge_sketches(*[sketch_levels(s, list(top), candidates) for s in df.randomSplit([1.0, 2.0], 3)], candidates=candidates)
    got = select_heavy_levels(df, top, min_share, candidates, buckets, sketches)
    assert kept(got) == kept(want)
    terms = [sorted(tuple(r) for r in lv.term_levels(x).collect()) for x in (got, want)]
    assert terms[0] == terms[1]


def test_heavy_levels_of_nothing_and_of_everything(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "a string")
    assert kept(select_heavy_levels(df, {"a": 1.0}, candidates=1)) == [("a", "x", 2, 1, 2), ("a", "y", 1, 2, 3)]
    assert select_heavy_levels(df.limit(0), {"a": 0.5}).count() == 0


def test_qr_tree_against_least_squares(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 900), "x": rng.normal(size=900), "z": rng.normal(size=900)})
    pdf["w"] = pdf.x + 1e-7 * pdf.z
    pdf["dup"] = 2 * pdf.x
    pdf["y"] = 3 + pdf.x - 2 * pdf.z + 0.1 * rng.normal(size=900)
    pdf.loc[pdf.g == 2, "z"] = 0.0
    df = spark.createDataFrame(pdf).repartition(40)
    for r in group_ols_qr(df, "g", "y", ["x", "z"]).collect():
        part = pdf[pdf.g == r["g"]]
        a = np.column_stack([np.ones(len(part)), part.x, part.z])
        want = np.linalg.lstsq(a, part.y, rcond=None)
        np.testing.assert_allclose([r["intercept"], r["x"], r["z"]], want[0], atol=1e-9)
        assert r["rss"] == pytest.approx(((part.y - a @ want[0]) ** 2).sum()) and r["n"] == len(part)
    near = group_ols_qr(df.filter("g < 2"), "g", "y", ["x", "w"]).collect()
    for r in near:  # w - x is 1e-7 z
        part = pdf[pdf.g == r["g"]]
        want = np.linalg.lstsq(np.column_stack([np.ones(len(part)), part.x, part.z]), part.y, rcond=None)[0]
        assert r["w"] * 1e-7 == pytest.approx(want[2], abs=1e-4)
    for r in group_ols_qr(df.filter("g < 2"), "g", "y", ["x", "dup"]).collect():
        assert r["dup"] == 0.0
    r = np.array(tall_qr(df, ["x", "z"], fan_in=2).first()["r"]).reshape(2, 2)
    np.testing.assert_allclose(r.T @ r, pdf[["x", "z"]].T @ pdf[["x", "z"]], atol=1e-8)


@pytest.mark.parametrize("seed", range(8))
def test_penalised_minimum_has_no_better_neighbour(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(40, 6))
    h, target, free = a.T @ a / 40, rng.normal(size=6), np.arange(6) == 0
    for reg, mix in ((0.5, 1.0), (0.1, 0.3), (0.2, 0.0), (0.0, 1.0)):
        def value(b, reg=reg, mix=mix):
            s = np.where(free, 0, b)
            return (b - target) @ h @ (b - target) / 2 + reg * (mix * np.abs(s).sum() + (1 - mix) / 2 * (s * s).sum())

        b = minimise(h, target, reg, mix, free, np.zeros(6))
        for _ in range(200):
            assert value(b) <= value(b + 1e-3 * rng.normal(size=6)) + 1e-12
        if reg == 0:
            np.testing.assert_allclose(b, target, atol=1e-6)
    # A term without information stays at 0.
    h[2], h[:, 2] = 0.0, 0.0
    assert minimise(h, target, 0.01, 1.0, free, np.zeros(6))[2] == 0.0


def test_penalised_path_skips_models_without_an_estimate(spark):
    rows = [("a", [0.5, 1.0], [2.0, 0.5, 3.0], 10), ("b", None, None, 0)]
    combined = spark.createDataFrame(rows, "k string, wlse array<double>, hess array<double>, n_used bigint")
    spec = TermSpec("y", ("x",), (), True, ("k",))
    path = penalised_path(combined, spec).collect()
    assert {r["k"] for r in path} == {"a"} and len(path) == 50
    assert path[0]["dof"] == 0 and path[-1]["dof"] == 1 and max(r["gap"] for r in path) < 1e-8
    assert path[0]["beta"][0] == pytest.approx(0.5 + 0.25 * 1.0)  # the intercept moves with the slope held at 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 100, 1000, 1025, 5000])
def test_every_n_is_permuted_exactly(spark, n):
    got = {seed: [r["p"] for r in spark.range(n).select("id", permuted(F.col("id"), n, seed).alias("p")).orderBy("id").collect()] for seed in (1, 2)}
    assert all(sorted(p) == list(range(n)) for p in got.values())
    if n >= 100:
        assert got[1] != got[2]
        assert abs(np.corrcoef(range(n), got[1])[0, 1]) < 5 / np.sqrt(n)


def test_random_index_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert sorted(r["row_id"] for r in random_index(df, ["k"], 3).collect()) == [0, 1, 2, 3]
    assert random_index(df.limit(0), ["k"], 3).count() == 0


def test_statistics_of_slices_add_up(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": 1e9 + rng.normal(size=3000), "s": rng.integers(0, 4, 3000), "one": np.where(np.arange(3000) == 7, 5.0, np.nan)})
    df = spark.createDataFrame(pdf).withColumn("one", F.when(~F.isnan("one"), F.col("one"))).withColumn("none", F.lit(None).cast("double"))
    columns = ["x", "one", "none"]
    slices = [describe(df.filter(F.col("s") == i), columns) for i in range(4)] + [describe(df.limit(0), columns)]
    got = {r["col"]: r for r in merge_stats(*slices).collect()}
    assert got["x"]["n"] == 3000 and got["x"]["mean"] == pytest.approx(pdf.x.mean(), rel=1e-15)
    assert got["x"]["sd"] == pytest.approx(pdf.x.std(), rel=1e-6) and got["x"]["max"] == pdf.x.max()
    assert (got["one"]["n"], got["one"]["mean"], got["one"]["sd"], got["one"]["min"]) == (1, 5.0, None, 5.0)
    assert (got["none"]["n"], got["none"]["mean"], got["none"]["sd"]) == (0, None, None)
    found = quantiles(merge_quantiles(*[quantile_sketches(df.filter(F.col("s") == i), ["x"]) for i in range(4)]), [0.25, 0.75]).collect()
    for r in found:
        assert abs((pdf.x < r["value"]).mean() - r["share"]) < 0.02


def test_onehot_by_dictionary_takes_new_levels_as_others(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "f string")
    hot, dictionary = ml.onehot_selected(df, {"f": 0.9})
    assert [r["level"] for r in dictionary.orderBy("level").collect()] == [OTHERS, "a", "b"]
    more, _ = ml.onehot_selected(spark.createDataFrame([("new",), ("b",)], "f string"), {"f": 0.9}, dictionary=dictionary, as_vector=True)
    assert [list(r["features_ONEHOT"].toArray()) for r in more.orderBy("f").collect()] == [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0]]
    last, _ = ml.onehot_selected(df, {"f": 0.9}, drop_last=True)
    assert {tuple(r["features_ONEHOT"]) for r in last.collect()} == {(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)}
