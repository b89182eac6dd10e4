"""Chunk fits, combining and evaluation on small frames, against numpy."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from onefold.operators import chunkfit
from onefold.operators.chunkfit import _Layout, coded_rows, fit_chunks, fit_in_place
from onefold.operators.combine import append_summaries, coefficients, combine, summary_terms
from onefold.operators.evaluate import constants, loglik, predict
from onefold.operators.newton import unpack
from onefold.operators.shrink import choose, estimates, path_terms, shrink_path
from onefold.plans import ml
from onefold.plans.regression import METHODS, Plan, extend, fit
from onefold.plans.sgd import _Block, _descend, _narrow, _record, dealt_rows, fit_sgd, load_sgd, save_sgd
from onefold.session import settle
from onefold.sources import store
from onefold.sources.rows import simulate_logistic, true_betas
from onefold.spec import OTHERS, Factor, TermSpec


def frame(n=3000, seed=1, chunks=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "x": rng.normal(size=n), "z": rng.normal(size=n), "f": rng.choice(["a", "b", "c", "d"], n),
        "g": rng.choice(["u", "v"], n), "partition_id": np.arange(n) % chunks})
    eta = 0.4 + 0.8 * pdf.x - 0.5 * (pdf.f == "b") + 0.9 * (pdf.g == "v")
    pdf["y"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    return pdf


SPEC = TermSpec("y", ("x", "z"), (Factor.build("f", ["a", "b", OTHERS], OTHERS), Factor.build("g", ["u", "v"], "first")),
                intercept=True)


def dense(pdf, spec=SPEC):
    f = pdf.f.where(pdf.f.isin(["a", "b"]), OTHERS)
    return np.column_stack([np.ones(len(pdf)), pdf.x, pdf.z, f == "a", f == "b", pdf.g == "v"]).astype(float)


def mle(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ ((p * (1 - p))[:, None] * x)
        b = b + np.linalg.solve(h, x.T @ (y - p))
    return b, h


def by_chunk(summary):
    return {r["partition_id"]: r for r in summary.collect()}


def test_term_order():
    assert SPEC.terms == ["intercept", "x", "z", "f_a", "f_b", "g_v"]


def test_chunks_match_numpy(spark):
    pdf = frame()
    got = by_chunk(fit_chunks(spark.createDataFrame(pdf), SPEC))
    for k, part in pdf.groupby("partition_id"):
        b, h = mle(dense(part), part.y.to_numpy())
        assert got[k]["status"] == "ok" and not got[k]["has_nan"]
        np.testing.assert_allclose(got[k]["theta"], b, atol=1e-9)
        np.testing.assert_allclose(unpack(np.array(got[k]["hess"]), 6), h, atol=1e-7)
        np.testing.assert_allclose(got[k]["v"], h @ b, atol=1e-7)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("limit", [40, 600])
def test_pieces_match_one_task(spark, compress, limit):
    """One chunk holds a third of the rows and is cut up; the result must not change."""
    pdf = frame(seed=4)
    pdf["partition_id"] = np.where(np.arange(len(pdf)) % 3 == 0, 0, 1 + np.arange(len(pdf)) % 7)
    df = spark.createDataFrame(pdf)
    whole = by_chunk(fit_chunks(df, SPEC, rows_per_task=None))
    cut = by_chunk(fit_chunks(df, SPEC, compress=compress, rows_per_task=limit))
    assert whole.keys() == cut.keys()
    for k in whole:
        assert cut[k]["status"] == whole[k]["status"] and cut[k]["n"] == whole[k]["n"]
        if whole[k]["status"] == "ok":
            for name in ("theta", "v", "hess"):
                np.testing.assert_allclose(cut[k][name], whole[k][name], atol=1e-7)
            assert cut[k]["loglik"] == pytest.approx(whole[k]["loglik"])


def test_copies_of_one_row_fill_a_chunk(spark):
    """A third of all rows are copies of one row: they are added up before they are moved."""
    pdf = frame(900)
    pdf = pd.concat([pdf, pd.concat([pdf.iloc[[0]]] * 450)], ignore_index=True)
    pdf["partition_id"] = 0
    got = by_chunk(fit_chunks(spark.createDataFrame(pdf), SPEC, rows_per_task=100))[0]
    b, _ = mle(dense(pdf), pdf.y.to_numpy())
    np.testing.assert_allclose(got["theta"], b, atol=1e-8)
    assert got["n"] == 1350


@pytest.mark.parametrize("limit", [None, 50])
def test_status_of_bad_chunks(spark, limit):
    pdf = frame(1200, chunks=4)
    pdf.loc[pdf.partition_id == 0, "f"] = "c"
    pdf.loc[pdf.partition_id == 1, "y"] = 1
    df = spark.createDataFrame(pdf)
    summary = fit_chunks(df, SPEC, rows_per_task=limit)
    got = by_chunk(summary)
    # Chunk 1 is of one class and joins chunk 0, which has only the baseline of f. The levels of f are of
    # one class there, so their rows go on, in turn, to chunks 2 and 3.
    assert set(got) == {0, 2, 3} and all(r["status"] == "ok" and r["aside"] is None for r in got.values())
    away = pdf[(pdf.partition_id == 1) & pdf.f.isin(["a", "b"])]
    assert got[0]["n"] == 600 - len(away) and sum(r["n"] for r in got.values()) == 1200
    row = combine(summary, SPEC).first()
    assert (row["n_total"], row["n_used"], row["chunks_total"], row["chunks_used"]) == (1200, 1200, 3, 3)
    assert row["estimable"] == [True] * 6


@pytest.mark.parametrize("limit", [None, 50])
def test_a_chunk_without_a_level_is_fitted(spark, limit):
    pdf = frame(1200, chunks=2)
    pdf.loc[(pdf.partition_id == 0) & (pdf.f == "a"), "f"] = "c"
    summary = fit_chunks(spark.createDataFrame(pdf), SPEC, rows_per_task=limit)
    got = by_chunk(summary)
    assert [got[k]["status"] for k in (0, 1)] == ["ok", "ok"] and got[0]["theta"][3] == got[0]["v"][3] == 0.0
    row = combine(summary, SPEC).first()
    assert row["n_used"] == 1200 and row["one_shot"][3] == got[1]["theta"][3]


def test_a_rare_level_costs_no_chunk(spark):
    """9 of 9,000 rows have the level: most chunks lack it, or have it in one class only."""
    pdf = frame(9000, seed=8, chunks=18).drop(columns="f")
    pdf["f"] = np.where(np.arange(9000) % 1000 == 7, "rare", np.where(np.arange(9000) % 2, "a", "b"))
    pdf.loc[np.arange(9000) % 1000 == 7, "y"] = [0, 1, 0, 1, 0, 1, 1, 0, 1]
    spec = TermSpec("y", ("x", "z"), (Factor.build("f", ["a", "b", "rare"], "a"),), intercept=True)
    row = combine(fit_chunks(spark.createDataFrame(pdf), spec), spec).first()
    assert row["n_used"] == row["n_total"] == 9000 and all(row["estimable"])
    x = np.column_stack([np.ones(9000), pdf.x, pdf.z, pdf.f == "b", pdf.f == "rare"]).astype(float)
    b, h = mle(x, pdf.y.to_numpy())
    assert np.all(np.abs(row["wlse"] - b) < 0.5 / np.sqrt(np.diag(h)) + 0.02)


def test_a_model_without_a_level_is_kept(spark):
    pdf = frame(4000, chunks=2)
    pdf["seg"] = np.where(np.arange(4000) % 4 < 2, "s", "t")
    pdf.loc[(pdf.seg == "t") & (pdf.f == "b"), "f"] = "a"
    spec = TermSpec("y", SPEC.continuous, SPEC.factors, True, ("seg",))
    rows = {r["seg"]: r for r in combine(fit_chunks(spark.createDataFrame(pdf), spec), spec).collect()}
    assert all(r["n_used"] == r["n_total"] == 2000 for r in rows.values())
    assert all(rows["s"]["estimable"]) and rows["t"]["estimable"] == [True, True, True, True, False, True]
    assert rows["t"]["wlse"][4] == 0.0


def test_chunks_without_a_row_key_are_drawn(spark):
    df = spark.createDataFrame(frame(6000).drop(columns="partition_id"))
    out = fit(df, Plan("y", ["x", "z"], {"g": 1.0}, baseline="first", rows_per_chunk=1500))
    row = out.combined.first()
    assert row["n_used"] == row["n_total"] == 6000 and row["chunks_total"] == 4
    keyed = fit(df, Plan("y", ["x", "z"], {"g": 1.0}, baseline="first", rows_per_chunk=1500, row_key=["x", "z"])).combined.first()
    np.testing.assert_allclose(row["wlse"], keyed["wlse"], atol=0.03)
    copies = df.select("g", "y")
    assert fit(copies, Plan("y", (), {"g": 1.0}, intercept=False, rows_per_chunk=1000)).combined.first()["n_used"] == 6000
    models = fit(df, Plan("y", ["x"], {}, keys=["g"], rows_per_chunk=1000)).combined.collect()
    assert sum(r["n_used"] for r in models) == 6000


def test_in_place_does_not_hang_on_files(spark):
    df = spark.createDataFrame(frame(8000)).drop("partition_id")
    for parts in (2, 400):
        row = combine(fit_in_place(df.repartition(parts), SPEC, rows_per_chunk=2000), SPEC).first()
        b, h = mle(dense(frame(8000)), frame(8000).y.to_numpy())
        assert row["n_used"] == 8000
        assert np.all(np.abs(row["wlse"] - b) < 0.3 / np.sqrt(np.diag(h)))


def test_constant_columns_and_single_classes_finish(spark, tmp_path):
    pdf = frame(400)
    pdf["c"] = 3.5
    for change in ({}, {"y": 1}):
        out = fit(spark.createDataFrame(pdf.assign(**change)), Plan("y", ["x", "c"], {"g": 1.0}, baseline="first"))
        out.save(str(tmp_path / f"m{len(change)}"))
        out.report()
        row, scored = out.combined.first(), out.evaluation().first()
        if change:
            assert row["wlse"] is None and scored["loglik_wlse"] is None and scored["n"] == 400
        else:
            assert row["estimable"] == [True, False, True, True] and scored["loglik_wlse"] < 0
        out.close()


def test_unseen_levels_are_counted_and_left_out(spark):
    old = frame(2000)
    old = old[old.f != "d"].assign(partition_id=0)
    plan = Plan("y", ["x"], {"f": 1.0}, baseline="first")
    first = fit(spark.createDataFrame(old), plan)
    new = frame(1500, seed=9).assign(partition_id=1)
    more = fit(spark.createDataFrame(new), plan, spec=first.spec, stored=first.summary)
    assert [tuple(r) for r in more.unseen.collect()] == [("f", "d", int((new.f == "d").sum()))]
    assert more.combined.first()["n_total"] == len(old) + int((new.f != "d").sum())
    assert more.evaluation().first()["n"] == int((new.f != "d").sum())
    with pytest.raises(ValueError, match="levels without a term"):
        fit(spark.createDataFrame(new), Plan("y", ["x"], {"f": 1.0}, baseline="first", unseen="error"), spec=first.spec)
    frame_rows = predict(spark.createDataFrame(new), first.spec, first.betas, "wlse", ["f"]).filter("prob IS NULL")
    assert {r["f"] for r in frame_rows.collect()} == {"d"}


def test_extension_keeps_everything(spark, tmp_path):
    plan = Plan("y", ["x"], {"f": 1.0}, baseline="first")
    parts = [frame(3000, seed=s).assign(partition_id=s) for s in (1, 2, 3)]
    folder = str(tmp_path / "model")
    fit(spark.createDataFrame(parts[0]), plan).save(folder)
    for part in parts[1:]:
        extend(spark.createDataFrame(part), plan, folder).save(folder)
    assert combine(store.load_table(spark, folder, "summary"), store.load_spec(spark, folder)).first()["n_total"] == 9000
    assert store.load_table(spark, folder, "combined").first()["n_used"] == 9000
    assert store.has_table(spark, folder, "levels") and store.has_table(spark, folder, "stats")


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_extension_uses_rows_held_back(spark, tmp_path, keys):
    """The rows of a level that is of one class in its file count, wait, and are fitted again with a file that has both."""
    plan = Plan("y", ["x"], {"f": 1.0}, baseline="first", keys=keys)
    parts = [frame(1500, seed=s).assign(partition_id=s) for s in (1, 2, 3)]
    parts[1].loc[parts[1].f == "b", "y"] = 1
    folder, used = str(tmp_path / "model"), []
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part)
        (extend(df, plan, folder) if i else fit(df, plan)).save(folder)
        total = store.load_table(spark, folder, "combined").groupBy().sum("n_total", "n_used").first()
        used.append((*total, store.load_table(spark, folder, "held").count()))
    few = int((parts[1].f == "b").sum())
    assert used == [(1500, 1500, 0), (3000, 3000, few), (4500, 4500, 0)]
    summary = store.load_table(spark, folder, "summary")
    assert summary.filter("status = 'returned'").groupBy().sum("n").first()[0] == -few
    whole = pd.concat(parts)
    for r in store.load_table(spark, folder, "combined").collect():
        rows = whole if not keys else whole[whole.g == r["g"]]
        assert r["n_used"] == len(rows) and r["aside"] == [0.0] * len(r["aside"])
        x = np.column_stack([np.ones(len(rows)), (rows.x - parts[0].x.mean()) / parts[0].x.std(), *(rows.f == v for v in "bcd")]).astype(float)
        b, h = mle(x, rows.y.to_numpy())
        assert np.all(np.abs(r["wlse"] - b) < 2.5 * np.sqrt(np.diag(np.linalg.inv(h))))


def test_an_old_file_does_not_wait_in_vain(spark, tmp_path):
    """Rows held for a level are read again only when the other class of the level arrives."""
    plan = Plan("y", ["x"], {"f": 1.0}, baseline="first")
    folder = str(tmp_path / "model")
    parts = [rare(1200, seed=s, chunks=1).assign(partition_id=s) for s in (1, 2, 3)]
    parts[2].loc[parts[2].f == "r", "y"] = 1
    held = []
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part)
        (extend(df, plan, folder) if i else fit(df, plan)).save(folder)
        row = store.load_table(spark, folder, "combined").first()
        held.append((row["n_used"], store.load_table(spark, folder, "held").count(), row["chunks_total"]))
    assert held == [(1200, 5, 1), (2400, 10, 2), (3600, 0, 3)]
    assert store.load_table(spark, folder, "combined").first()["aside"] == [0.0] * 5


def test_all_terms_count_against_the_limit(spark):
    df = spark.createDataFrame(frame(500))
    plan = {"response": "y", "continuous": ["x", "z"], "keep_top": {"f": 1.0}}
    assert fit(df, Plan(**plan, max_terms=7)).spec.p == 7
    with pytest.raises(ValueError, match="more than 6 terms"):
        fit(df, Plan(**plan, max_terms=6))


def test_separated_chunk_is_left_out(spark):
    pdf = pd.DataFrame({"x": np.linspace(-1, 1, 60), "partition_id": 0})
    pdf["y"] = (pdf.x > 0).astype(int)
    spec = TermSpec("y", ("x",), (), True)
    for limit in (None, 20):  # the whole model: there is nothing to pool it with
        got = fit_chunks(spark.createDataFrame(pdf), spec, rows_per_task=limit, max_iter=12).first()
        assert got["status"] == "not_converged" and got["theta"] is None


def rare(n=20_000, seed=3, chunks=10):
    """One continuous column and a factor whose level r has five rows, all of class 0."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"x": rng.normal(size=n), "f": rng.choice(["a", "b", "c"], n), "partition_id": np.arange(n) % chunks})
    pdf.loc[rng.choice(n, 5, replace=False), "f"] = "r"
    pdf["y"] = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + pdf.x - (pdf.f == "b"))))).astype(int)
    pdf.loc[pdf.f == "r", "y"] = 0
    return pdf


@pytest.mark.parametrize("limit", [None, 500])
def test_a_level_of_one_class_costs_only_its_term(spark, limit):
    pdf = rare()
    spec = TermSpec("y", ("x",), (Factor.build("f", ["a", "b", "c", "r"], "a"),), True)
    summary = fit_chunks(spark.createDataFrame(pdf), spec, rows_per_task=limit)
    got = combine(summary, spec).first()
    assert summary.count() == 10 and got["n_used"] == got["n_total"] == len(pdf)
    assert got["estimable"] == [True] * 4 + [False] and got["aside"] == [0.0] * 4 + [5.0]
    top = bottom = 0
    for _, part in pdf[pdf.f != "r"].groupby("partition_id"):
        x = np.column_stack([np.ones(len(part)), part.x, part.f == "b", part.f == "c"]).astype(float)
        b, h = mle(x, part.y.to_numpy())
        top, bottom = top + h @ b, bottom + h
    np.testing.assert_allclose(got["wlse"], [*np.linalg.solve(bottom, top), 0.0], atol=1e-6)


def test_rows_set_aside_move_to_chunks_of_both_classes(spark):
    """Levels rare enough to be of one class in most chunks, in two models; no row is lost and estimates are sound."""
    pdf = rare(seed=5)
    rng = np.random.default_rng(6)
    pdf["g"] = np.where(rng.random(len(pdf)) < 0.004, "s", "t")
    pdf.loc[(pdf.g == "s") & (rng.random(len(pdf)) < 0.6), "y"] = 0
    pdf["k"] = np.where(np.arange(len(pdf)) % 3 == 0, "m", None)
    spec = TermSpec("y", ("x",), (Factor.build("f", ["a", "b", "c", "r"], "a"), Factor.build("g", ["t", "s"], "t")), True, ("k",))
    df = spark.createDataFrame(pdf).withColumn("k", F.coalesce("k", F.lit("n")))
    alone = fit_chunks(df, spec, pool=False).collect()
    assert sum((r["aside"] or [0] * 6)[5] > 0 for r in alone) > 2
    summary = settle(fit_chunks(df, spec))
    for r in combine(summary, spec).collect():
        rows = pdf[pdf.k.isna() if r["k"] == "n" else pdf.k == "m"]
        assert r["n_used"] == r["n_total"] == len(rows) and r["aside"][5] == 0 and r["estimable"][5]
        keep = rows[rows.f != "r"]
        x = np.column_stack([np.ones(len(keep)), keep.x, keep.f == "b", keep.f == "c", keep.g == "s"]).astype(float)
        b, h = mle(x, keep.y.to_numpy())
        got = np.delete(r["wlse"], 4)
        assert np.all(np.abs(got - b) < 1.5 * np.sqrt(np.diag(np.linalg.inv(h))))
    assert sum(r["hits"] for r in summary.collect()) == pdf.y.sum()


def test_classes_in_different_chunks_are_brought_together(spark):
    """A level that is all 0 in one chunk and all 1 in another has an estimate once they meet."""
    pdf = frame(3000)
    pdf.loc[:, "f"] = np.where(np.arange(3000) % 50 < 3, "r", "a")
    pdf.loc[pdf.f == "r", "y"] = (pdf.partition_id[pdf.f == "r"] == 1).astype(int)
    spec = TermSpec("y", (), (Factor.build("f", ["a", "r"]),))
    got = combine(fit_chunks(spark.createDataFrame(pdf), spec), spec).first()
    rare_rows = pdf[pdf.f == "r"]
    assert got["wlse"][1] == pytest.approx(np.log(rare_rows.y.sum() / (len(rare_rows) - rare_rows.y.sum())), abs=1e-8)
    assert got["n_used"] == 3000 and got["aside"] == [0.0, 0.0]


def test_one_class_levels_hold_only_their_rows(spark, tmp_path):
    pdf, folder = rare(6000), str(tmp_path / "m")
    df = spark.createDataFrame(pdf)
    plan = Plan("y", ["x"], {"f": 1.0}, baseline="first", rows_per_chunk=1000)
    fit(df.filter("partition_id < 5"), plan).save(folder)
    out = extend(df.filter("partition_id >= 5"), plan, folder)
    assert out.combined.first()["n_used"] == 6000 and out.held.count() == 5


def test_no_usable_chunk(spark):
    pdf = frame(100)
    pdf["y"] = 1
    row = combine(fit_chunks(spark.createDataFrame(pdf), SPEC), SPEC).first()
    assert row["chunks_used"] == 0 and row["wlse"] is None and row["n_total"] == 100


def test_combine_formula_and_order(spark):
    df = spark.createDataFrame(frame(chunks=5))
    summary = fit_chunks(df, SPEC)
    rows = by_chunk(summary)
    h = sum(unpack(np.array(r["hess"]), 6) for r in rows.values())
    v = sum(np.array(r["v"]) for r in rows.values())
    want = np.linalg.solve(h, v)
    a = combine(summary, SPEC).first()
    np.testing.assert_allclose(a["wlse"], want, atol=1e-9)
    b = combine(summary.repartition(4, F.rand(1)), SPEC).first()
    np.testing.assert_allclose(a["wlse"], b["wlse"], atol=1e-10)
    halves = append_summaries(summary.filter("partition_id < 2"), summary.filter("partition_id >= 2"))
    np.testing.assert_allclose(combine(halves, SPEC).first()["wlse"], want, atol=1e-9)


def test_one_chunk_is_the_mle_of_spark_ml(spark):
    df = spark.createDataFrame(frame()).withColumn("partition_id", F.lit(0).cast("bigint"))
    wlse = combine(fit_chunks(df, SPEC), SPEC).first()["wlse"]
    x = ml.term_features(df, SPEC)
    model = ml.fit_logistic(x)
    np.testing.assert_allclose(wlse, [model.intercept, *model.coefficients], atol=1e-6)


def test_loglik_and_prediction(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    x, y = dense(pdf), pdf.y.to_numpy()
    best, _ = mle(x, y)
    other = best + 0.1
    betas = constants({"best": best, "other": other}, spark)
    row = loglik(df, SPEC, betas, ["best", "other"]).first()
    for name, b in (("best", best), ("other", other)):
        p = 1 / (1 + np.exp(-x @ b))
        assert row[f"loglik_{name}"] == pytest.approx(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert row["loglik_best"] > row["loglik_other"]
    rows = df.withColumn("i", F.monotonically_increasing_id())
    got = predict(rows, SPEC, betas, "best", ["x"]).toPandas().sort_values("x")["prob"]
    want = pd.Series(1 / (1 + np.exp(-x @ best)))[np.argsort(pdf.x.to_numpy())]
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), atol=1e-10)


@pytest.mark.parametrize("compress", [True, False])
def test_rows_with_nulls_are_left_out(spark, compress):
    df = spark.createDataFrame(frame())
    holes = df
    for i, c in enumerate(["y", "x", "f"]):
        holes = holes.withColumn(c, F.when(F.pmod(F.hash("x", "z"), F.lit(10)) != i, F.col(c)))
    kept = holes.dropna()
    assert 0 < kept.count() < df.count()
    a, b = (combine(fit_chunks(rows, SPEC, compress=compress), SPEC) for rows in (holes, kept))
    np.testing.assert_allclose(a.first()["wlse"], b.first()["wlse"], atol=1e-9)
    assert a.first()["n_total"] == kept.count()
    got, want = (loglik(rows, SPEC, a, ["wlse"]).first() for rows in (holes, kept))
    assert got["n"] == want["n"] and got["loglik_wlse"] == pytest.approx(want["loglik_wlse"])


def test_no_estimate_beats_the_mle(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    c = combine(fit_chunks(df, SPEC), SPEC)
    betas = estimates(c, shrink_path(c, SPEC), SPEC)
    best, _ = mle(dense(pdf), pdf.y.to_numpy())
    top = loglik(df, SPEC, constants({"mle": best}, spark), ["mle"]).first()["loglik_mle"]
    row = loglik(df, SPEC, betas, METHODS).first()
    assert all(row[f"loglik_{m}"] <= top + 1e-9 for m in METHODS)
    assert row["loglik_wlse"] > top - 1.0


def test_extreme_predictor_has_finite_loglik(spark):
    pdf = pd.DataFrame({"x": [1000.0, -1000.0], "y": [1, 0]})
    spec = TermSpec("y", ("x",))
    row = loglik(spark.createDataFrame(pdf), spec, constants({"m": [1.0]}, spark), ["m"]).first()
    assert row["loglik_m"] == pytest.approx(0.0)


def test_many_models_equal_separate_runs(spark):
    pdf = frame(4000, seed=9)
    pdf["m"] = np.where(np.arange(len(pdf)) % 3 == 0, "hot", "cold")
    keyed = TermSpec(SPEC.response, SPEC.continuous, SPEC.factors, True, ("m",))
    df = spark.createDataFrame(pdf)
    combined = combine(fit_chunks(df, keyed), keyed)
    path = shrink_path(combined, keyed)
    betas = estimates(combined, path, keyed)
    together = {r["m"]: r for r in betas.collect()}
    scores = {r["m"]: r for r in loglik(df, keyed, betas, METHODS).collect()}
    for m in ("hot", "cold"):
        own = df.filter(F.col("m") == m)
        c = combine(fit_chunks(own, SPEC), SPEC)
        b = estimates(c, shrink_path(c, SPEC), SPEC)
        alone = b.first()
        for name in METHODS:
            np.testing.assert_allclose(together[m][name], alone[name], atol=1e-9)
        assert scores[m]["loglik_aic"] == pytest.approx(loglik(own, SPEC, b, ["aic"]).first()["loglik_aic"])


def test_choice_is_the_argmin(spark):
    c = combine(fit_chunks(spark.createDataFrame(frame()), SPEC), SPEC)
    path = shrink_path(c, SPEC, "lasso").toPandas()
    best = {r["criterion"]: r for r in choose(shrink_path(c, SPEC, "lasso"), SPEC).collect()}
    for name in ("aic", "bic"):
        assert best[name]["step"] == path.loc[path[name].idxmin(), "step"]
    long = path_terms(shrink_path(c, SPEC), SPEC)
    assert long.count() == 6 * shrink_path(c, SPEC).count()
    with pytest.raises(ValueError):
        shrink_path(c, SPEC, "ridge")


def test_fit_in_place_covers_all_rows(spark):
    pdf = frame(5000)
    df = spark.createDataFrame(pdf.drop(columns="partition_id")).repartition(3)
    summary = fit_in_place(df, SPEC, rows_per_chunk=400).cache()
    rows = summary.collect()
    assert sum(r["n"] for r in rows) == 5000
    assert all(200 <= r["n"] <= 600 for r in rows)
    assert len({r["partition_id"] for r in rows}) == len(rows)
    best, h = mle(dense(pdf), pdf.y.to_numpy())
    wlse = np.array(combine(summary, SPEC).first()["wlse"])
    assert np.max(np.abs(wlse - best) * np.sqrt(np.diag(h))) < 1.0


def test_runs_cut_any_batching():
    rng = np.random.default_rng(0)
    for size in (1, 7, 50):
        sizes = rng.integers(1, 40, 12)
        pdf = pd.DataFrame({"i": np.arange(sizes.sum())})
        cuts = np.cumsum(sizes)[:-1]
        batches = [pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(pdf)])]
        runs = list(chunkfit._runs(iter(batches), size))
        assert np.concatenate([r["i"] for r in runs]).tolist() == pdf["i"].tolist()
        assert all(len(r) == size for r in runs[:-1]) and len(runs[-1]) <= 1.5 * size


def test_recovers_true_coefficients(spark):
    df = simulate_logistic(spark, 40_000, 10, 8, seed=3)
    spec = TermSpec("label", tuple(f"x{j}" for j in range(10)))
    c = combine(fit_chunks(df, spec), spec)
    out = estimates(c, shrink_path(c, spec), spec).first()
    truth = np.array(true_betas(10))
    np.testing.assert_allclose(out["wlse"], truth, atol=0.2)
    assert np.array_equal(np.array(out["bic"]) != 0, truth != 0)
    assert df.filter("label not in (0, 1)").isEmpty()
    assert df.select("partition_id").distinct().count() == 8


def test_sgd_nears_the_optimum_and_continues(spark):
    pdf = frame(6000)
    df = spark.createDataFrame(pdf).repartition(4).persist()
    best, _ = mle(dense(pdf), pdf.y.to_numpy())
    one = fit_sgd(df, SPEC, epochs=1, batch_rows=64)
    more = fit_sgd(df, SPEC, epochs=5, batch_rows=64, warm=one)
    scores = loglik(df, SPEC, constants({"best": best, "one": one, "more": more}, spark),
                    ["best", "one", "more"]).first()
    assert scores["loglik_more"] > scores["loglik_one"]
    assert scores["loglik_best"] - scores["loglik_more"] < 0.005 * abs(scores["loglik_best"])


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_main_job_saves_and_reloads(spark, tmp_path, keys):
    pdf = frame(2500).drop(columns="partition_id")
    pdf["id"] = np.arange(len(pdf))
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    plan = Plan("y", ["x", "z"], {"f": 0.6}, baseline={"f": OTHERS}, keys=keys, row_key=["id"], rows_per_chunk=500)
    out = fit(df, plan)
    assert out.spec.terms[0] == "intercept" and "f_000_OTHERS" not in out.spec.terms
    out.save(str(tmp_path))
    assert store.load_spec(spark, str(tmp_path)) == out.spec
    again = combine(store.load_table(spark, str(tmp_path), "summary"), out.spec)
    first = {tuple(r[k] for k in keys): r["wlse"] for r in out.combined.collect()}
    for r in again.collect():
        np.testing.assert_allclose(r["wlse"], first[tuple(r[k] for k in keys)], atol=1e-9)
    run = out.run().collect()
    assert sum(r["n_total"] for r in run) == 2450
    scores = out.evaluation().first()
    assert scores["loglik_wlse"] < 0
    # Extending by the same rows doubles the rows and leaves the estimate alone.
    twice = fit(df, plan, spec=out.spec, stored=store.load_table(spark, str(tmp_path), "summary"))
    assert sum(r["n_total"] for r in twice.combined.collect()) == 4900
    for r in twice.combined.collect():
        np.testing.assert_allclose(r["wlse"], first[tuple(r[k] for k in keys)], atol=1e-8)


def test_summary_terms_reads_the_diagonal(spark):
    summary = fit_chunks(spark.createDataFrame(frame()), SPEC)
    got = {(r["partition_id"], r["term"]): r["h"] for r in summary_terms(summary, SPEC).collect()}
    for k, row in by_chunk(summary).items():
        diagonal = np.diag(unpack(np.array(row["hess"]), 6))
        np.testing.assert_allclose([got[k, t] for t in SPEC.terms], diagonal)


def test_coefficient_table(spark):
    c = combine(fit_chunks(spark.createDataFrame(frame()), SPEC), SPEC)
    got = coefficients(c, SPEC, {"w": "wlse", "o": "one_shot"}).collect()
    assert len(got) == 12
    row = c.first()
    assert {r["term"]: r["estimate"] for r in got if r["method"] == "w"} == dict(zip(SPEC.terms, row["wlse"]))


def test_a_stored_sgd_run_goes_on(spark, tmp_path):
    df = spark.createDataFrame(frame(3000))
    whole = fit_sgd(df, SPEC, epochs=1, parts=2)
    save_sgd(df, str(tmp_path / "sgd"), SPEC, whole)
    spec, theta = load_sgd(df, str(tmp_path / "sgd"))
    assert spec == SPEC and theta == whole
    more = fit_sgd(df, spec, epochs=2, parts=2, warm=theta)
    scored = loglik(df, spec, constants({"one": whole, "more": more}, spark), ["one", "more"]).first()
    assert scored["loglik_more"] >= scored["loglik_one"] - 1.0


def plain_descent(pdf, spec, start, rate, batch_rows):
    """One mini-batch after the other on the written-out matrix."""
    beta, mean = start.copy(), np.zeros(len(start))
    for step, low in enumerate(range(0, len(pdf), batch_rows), 1):
        part = pdf.iloc[low: low + batch_rows]
        x = _Layout(spec).design(part).dense()
        slope = x.T @ (part.hits.to_numpy() - 1 / (1 + np.exp(-x @ beta))) / len(part)
        beta = beta + rate / np.sqrt(step) * slope
        mean += 4.0 / (step + 3.0) * (beta - mean)
    return mean


@pytest.mark.parametrize("continuous, widths, intercept", [((), [5], False), ((), [3, 2], True), ((), [60], True), (("x",), [3], True)])
def test_a_descent_over_blocks_follows_the_plain_one(continuous, widths, intercept):
    rng = np.random.default_rng(7)
    factors = [Factor.build(f"f{i}", [f"l{j}" for j in range(w + intercept)], "l0" if intercept else "none") for i, w in enumerate(widths)]
    spec = TermSpec("y", continuous, tuple(factors), intercept)
    n = 3007
    pdf = pd.DataFrame({c: rng.normal(size=n) for c in continuous} | {f"code_f{i}": rng.integers(0, w + intercept, n) for i, w in enumerate(widths)})
    pdf["hits"], pdf["trials"] = rng.integers(0, 2, n).astype(float), 1.0
    start = rng.normal(size=spec.p)
    blocks = [_Block(_Layout(spec), part, 32) for part in (pdf[:1024], pdf[1024:])]
    mean, seen = _descend(blocks, start, 2.0)
    assert seen == n
    np.testing.assert_allclose(mean, plain_descent(pdf, spec, start, 2.0, 32), atol=1e-12)


def test_a_step_of_the_descent_is_cheap():
    # 60,000 steps on five levels: about a second, some 30 when each step cut its own frame.
    rng = np.random.default_rng(8)
    spec = TermSpec("y", (), (Factor.build("f0", list("abcde")),))
    pdf = pd.DataFrame({"code_f0": rng.integers(0, 5, 64_000), "hits": rng.integers(0, 2, 64_000).astype(float), "trials": 1.0})
    blocks = [_Block(_Layout(spec), pdf, 32)]
    began = time.process_time()
    for _ in range(30):
        _descend(blocks, np.zeros(5), 2.0)
    assert time.process_time() - began < 10


def test_a_descent_deals_packs_and_not_rows(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("CAST(id AS DOUBLE) x", "CAST(id % 3 AS STRING) f", "id % 2 y", "0 partition_id")
    spec = TermSpec("y", ("x",), (Factor.build("f", ["0", "1", "2"]),))
    dealt = dealt_rows(coded_rows(df, spec, compress=False).drop("partition_id"), spec, 1, 3)
    parts = dealt.rdd.map(lambda r: bytes(r["rows"])).glom().collect()
    assert len(parts) == 3 and all(len(packs) == 4 for packs in parts)
    rows = [np.frombuffer(b"".join(packs), _record(_Layout(spec))) for packs in parts]
    assert max(map(len, rows)) - min(map(len, rows)) <= 4
    seen = np.concatenate(rows)
    assert np.array_equal(np.sort(seen["x"]), np.arange(20_000))
    assert np.array_equal(seen["code_f"], seen["x"] % 3) and np.array_equal(seen["hits"], seen["x"] % 2)
    assert all(abs(np.mean(r["x"][:500]) - 10_000) > 1 and (np.diff(r["x"]) < 0).sum() > len(r) // 3 for r in rows)
    assert parts == dealt.rdd.map(lambda r: bytes(r["rows"])).glom().collect()


def test_narrowed_counts_are_the_same_numbers():
    for values in ([0.0, 1.0, 255.0], [0.0, 256.0], [0.5, 1.0], [-1.0, 0.0], []):
        got = _narrow(np.array(values))
        assert got.tolist() == values
    assert _narrow(np.array([0.0, 1.0])).nbytes == 2
