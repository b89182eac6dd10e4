"""Prediction and log-likelihood of several coefficient vectors in one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.functions import log_density, log_density_from_prob, logistic
from onefold.operators.prepare import add_codes, coded, complete_rows, standardise_columns
from onefold.session import BROADCAST_ROWS, settle, small_side
from onefold.spec import TermSpec


def predictor(spec: TermSpec, beta: Column) -> Column:
    """x'beta of a coded row, with ``beta`` an array column or literal in term order.

    A factor costs one array access, however many levels it has.
    """
    eta = F.get(beta, F.lit(0)) if spec.intercept else F.lit(0.0)
    at = int(spec.intercept)
    for i, c in enumerate(spec.continuous):
        eta = eta + F.col(c).cast("double") * F.get(beta, F.lit(at + i))
    for f in spec.factors:
        code = F.col(f"code_{f.name}")
        # Null, and so the predictor, for an unseen level.
        eta = eta + F.when(code < len(f.slots), F.get(beta, code + spec.offset(f))).when(code.isNotNull(), 0.0)
    return eta


def _with_predictors(df: DataFrame, spec: TermSpec, betas: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Coded rows with one column ``__eta_<method>`` each.

    As a column of its own, a predictor is computed once per row though the density uses it
    more than once.
    """
    rows, arrays = with_coefficients(df, spec, betas, methods)
    return rows.withColumns({f"__eta_{m}": predictor(spec, b) for m, b in arrays.items()})


def _literal(values: Sequence[float] | None) -> Column:
    """An array literal; null for a model without an estimate."""
    return F.lit(None).cast("array<double>") if values is None else F.array(*[F.lit(float(b)) for b in values])


def with_coefficients(df: DataFrame, spec: TermSpec, betas: DataFrame, methods: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Coded rows plus the coefficient arrays to use on them.

    Without model keys the p numbers per method become literals. With keys the table of
    coefficient rows is joined, by broadcast if its cells are few enough.
    """
    coded = standardise_columns(add_codes(df, spec), dict(spec.scales))
    if not spec.keys:
        rows = betas.select(*methods).take(2)
        if len(rows) != 1:
            raise ValueError("expected one coefficient row")
        literals = {m: _literal(rows[0][m]) for m in methods}
        return coded, literals
    table = settle(betas.select(*spec.keys, *[F.col(m).alias(f"__{m}") for m in methods]))
    limit = max(1, BROADCAST_ROWS * 8 // (spec.p * len(methods)))
    return coded.join(small_side(table, limit), list(spec.keys)), {m: F.col(f"__{m}") for m in methods}


def loglik(df: DataFrame, spec: TermSpec, betas: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``keys, n, loglik_<method>...``: every method summed in the same scan.

    Over complete rows of known levels, as in the fit; null where a model has no estimate.
    """
    rows = _with_predictors(coded(complete_rows(df, spec), spec).select(*df.columns), spec, betas, methods)
    y = F.col(spec.response).cast("double")
    sums = [F.sum(log_density(y, F.col(f"__eta_{m}"))).alias(f"loglik_{m}") for m in methods]
    return rows.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def predict(df: DataFrame, spec: TermSpec, betas: DataFrame, method: str, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns plus the predicted probability of 1."""
    rows = _with_predictors(df, spec, betas, [method])
    return rows.select(*keep, logistic(F.col(f"__eta_{method}")).alias("prob"))


def loglik_from_prob(df: DataFrame, y: str, p0: Column, p1: Column) -> DataFrame:
    """Log-likelihood from class probabilities that some model has predicted."""
    density = log_density_from_prob(F.col(y), p0, p1)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(density).alias("loglik"))


def score_check(df: DataFrame, spec: TermSpec, betas: DataFrame, method: str, by: Sequence[str]) -> DataFrame:
    """Largest absolute score equation |sum x (y - p)| per group, as plain column sums.

    Zero at a maximum of the likelihood; the independent test of a fit.
    """
    rows = _with_predictors(complete_rows(df, spec), spec, betas, [method])
    rows = rows.withColumn(
        "__residual", F.col(spec.response).cast("double") - logistic(F.col(f"__eta_{method}")))
    residual = F.col("__residual")
    cells: list[Column] = [residual] if spec.intercept else []
    cells += [residual * F.col(c) for c in spec.continuous]
    for f in spec.factors:
        cells += [F.when(F.col(f"code_{f.name}") == i, residual).otherwise(0.0)
                  for i in range(len(f.slots))]
    sums = [F.abs(F.sum(c)) for c in cells]
    worst = F.greatest(*sums) if len(sums) > 1 else sums[0]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), worst.alias("score"))


def constants(values: Mapping[str, Sequence[float]], spark) -> DataFrame:
    """A one-row coefficient frame from driver-side vectors, e.g. of a saved model."""
    names = list(values)
    schema = ", ".join(f"`{m}` array<double>" for m in names)
    return spark.createDataFrame([tuple([float(x) for x in values[m]] for m in names)], schema)
