"""The flight preset and the command line, on small made-up files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from onefold.plans import job
from onefold.plans.flights import CONTINUOUS, FLIGHT_SCHEMA, fit_flights
from onefold.sources.csv import write_csv
from onefold.sources.store import load_spec, load_table


def flights(spark, n, seed=0):
    fields = [f.split() for f in FLIGHT_SCHEMA.split(", ")]
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({name: np.nan for name, _ in fields}, index=range(n))
    for c in CONTINUOUS:
        pdf[c] = rng.integers(1, 30, n)
    pdf["Month"], pdf["DayOfWeek"] = rng.integers(1, 13, n), rng.integers(1, 8, n)
    for c, k in (("UniqueCarrier", 8), ("Origin", 12), ("Dest", 12)):
        pdf[c] = [f"{c[0]}{int(v)}" for v in rng.exponential(k / 4, n).clip(0, k - 1)]
    pdf["ArrDelay"] = rng.normal(size=n) + 0.3 * (pdf.Month == 7)
    pdf.loc[::40, "ArrDelay"] = np.nan
    df = spark.createDataFrame(pdf)
    return df.select(*[
        F.when(~F.col(c).cast("string").isin("NaN"), F.col(c)).cast(t).alias(c) for c, t in fields])


def test_flight_files(spark, tmp_path):
    path = str(tmp_path / "flights")
    write_csv(flights(spark, 8000), path, files=3, compression="bzip2")
    out = fit_flights(spark, path, rows_per_chunk=3000)
    assert out.spec.terms[:8] == ["intercept", *sorted(CONTINUOUS)]
    assert {"Month_1", "DayOfWeek_1", "Origin_000_OTHERS"}.isdisjoint(out.spec.terms)
    run = out.run().first()
    assert run["n_total"] == 7800 and run["chunks_total"] == 3 and run["chunks_used"] == 3
    scores = out.evaluation().first()
    assert scores["n"] == 7800
    assert scores["loglik_wlse"] > scores["loglik_one_shot"] - 1 and scores["loglik_wlse"] > scores["loglik_bic"]


@pytest.mark.parametrize("in_place", [False, True])
def test_command_line_fits_saves_and_extends(spark, tmp_path, in_place, capsys):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(6000), "a": rng.normal(size=6000), "f": rng.choice(list("pqr"), 6000)})
    pdf["y"] = (rng.random(6000) < 1 / (1 + np.exp(-pdf.a))).astype(int)
    first, second, model = (str(tmp_path / d) for d in ("first", "second", "model"))
    spark.createDataFrame(pdf[:4000]).write.parquet(first)
    spark.createDataFrame(pdf[4000:]).write.parquet(second)
    common = ["--response", "y", "--continuous", "a", "--factors", "f=1.0", "--row-key", "id",
              "--rows-per-chunk", "500", *(["--in-place"] if in_place else [])]
    fit, files = job.run(spark, job.parse(["--input", first, *common]))
    fit.save(model, files)
    fit.report()
    assert "loglik_wlse" in capsys.readouterr().out
    assert load_spec(spark, model).terms == ["intercept", "a", "f_q", "f_r"]
    more, new = job.run(spark, job.parse(["--input", f"{first},{second}", "--extend", model, *common]))
    assert new and not set(new) & set(files)
    assert job.run(spark, job.parse(["--input", first, "--extend", model, *common])) == (None, [])
    assert more.combined.first()["n_total"] == 6000
    stored = load_table(spark, model, "coef").filter("method = 'wlse' and term = 'a'").first()["estimate"]
    assert abs(stored - 1.0) < 0.2 and abs(more.combined.first()["wlse"][1] - 1.0) < 0.2
