"""Spark ML baselines: the one-hot feature stages and maximum-likelihood or elastic-net fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.functions import vector_item
from onefold.operators import levels as lv
from onefold.operators.evaluate import loglik_from_prob
from onefold.operators.prepare import coded, standardise_columns
from onefold.plans.regression import Plan, learn_spec, prepare
from onefold.session import settle
from onefold.spec import OTHERS, TermSpec


def onehot_stages(factors: Sequence[str], drop_last: bool = False, out: str = "features_ONEHOT") -> Pipeline:
    """Index by falling frequency, encode, assemble; all factors go through each stage together."""
    idx = [f"{c}_IDX" for c in factors]
    hot = [f"{c}_ONEHOT" for c in idx]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(factors), outputCols=idx, stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=drop_last),
        VectorAssembler(inputCols=hot, outputCol=out),
    ])


def collapse(df: DataFrame, spec: TermSpec) -> DataFrame:
    """Factor columns as text with rare levels replaced; the indexer then sees kept levels only."""
    new = {}
    for f in spec.factors:
        text = F.col(f.name).cast("string")
        if OTHERS in f.levels:
            text = F.when(text.isin([lv for lv in f.levels if lv != OTHERS]), text).otherwise(F.lit(OTHERS))
        new[f.name] = text
    return df.withColumns(new) if new else df


def onehot(df: DataFrame, spec: TermSpec, drop_last: bool = False, sparse: bool = False) -> tuple[DataFrame, PipelineModel]:
    """Append the one-hot vector of all factors, as an array unless ``sparse``."""
    factors = [f.name for f in spec.factors]
    rows = collapse(df, spec)
    model = onehot_stages(factors, drop_last).fit(rows)
    out = model.transform(rows)
    if not sparse:
        out = out.withColumn("features_ONEHOT", vector_to_array("features_ONEHOT", "float64"))
    helpers = [f"{c}_IDX" for c in factors] + [f"{c}_IDX_ONEHOT" for c in factors]
    return out.drop(*helpers), model


def _indicators(code: str, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == F.col(code)).cast("double"))


def onehot_selected(df: DataFrame, keep_top: Mapping[str, float], min_share: float | None = None, dictionary: DataFrame | None = None,
                    drop_last: bool = False, as_vector: bool = False, out: str = "features_ONEHOT") -> tuple[DataFrame, DataFrame]:
    """Select levels, collapse the others and append the one-hot vector of all factors, in one call; also the dictionary.

    A given ``dictionary`` (``term_levels``, as stored) is used as it is, so that further data get the same
    positions; levels that it lacks go to ``OTHERS``, or are left out if it has none. Positions follow the factors, then
    the level names; ``drop_last`` leaves out the rarest level. Built from codes by expressions: no row passes through a fit.
    """
    factors = list(keep_top)
    if dictionary is None:
        dictionary = settle(lv.term_levels(lv.select_levels(lv.level_counts(df, factors), keep_top, min_share)))
    spec = TermSpec.from_levels(dictionary, "", factors=factors, baseline="last" if drop_last else "none")
    rows = coded(df, spec)
    hot = F.concat(*[_indicators(f"code_{f.name}", len(f.slots)) for f in spec.factors if f.slots])
    rows = rows.withColumn(out, array_to_vector(hot) if as_vector else hot)
    return rows.drop(*[f"code_{f.name}" for f in spec.factors]), dictionary


def scaled(df: DataFrame, columns: Sequence[str], out: str = "features_x_std") -> DataFrame:
    """Assemble the continuous columns and scale them to mean 0, sd 1."""
    raw = VectorAssembler(inputCols=list(columns), outputCol="features_x_raw").transform(df)
    scaler = StandardScaler(inputCol="features_x_raw", outputCol=out, withMean=True, withStd=True)
    return scaler.fit(raw).transform(raw).drop("features_x_raw")


def features(df: DataFrame, spec: TermSpec, drop_last: bool = True) -> DataFrame:
    """Response and ``features``: scaled continuous columns, then the one-hot vector."""
    parts, out = [], df
    if spec.continuous:
        out = scaled(out, spec.continuous)
        parts.append("features_x_std")
    if spec.factors:
        out, _ = onehot(out, spec, drop_last=drop_last, sparse=True)
        parts.append("features_ONEHOT")
    out = VectorAssembler(inputCols=parts, outputCol="features").transform(out)
    return out.withColumn("label", F.col(spec.response).cast("double"))


def term_features(df: DataFrame, spec: TermSpec) -> DataFrame:
    """``label, features`` with the features in term order (no intercept column), sparse.

    The vector is built from the factor codes: one column per factor, whose number of codes is
    given as metadata, so that the encoder needs no scan. Rows of unseen levels are left out.
    """
    rows = standardise_columns(coded(df, spec), dict(spec.scales))
    codes = [
        F.col(f"code_{f.name}").cast("double").alias(
            f"c{i}", metadata={"ml_attr": {"type": "nominal", "vals": [str(v) for v in range(len(f.slots) + 1)]}})
        for i, f in enumerate(spec.factors)
    ]
    parts = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(spec.continuous)]
    rows = rows.select(F.col(spec.response).cast("double").alias("label"), *parts, *codes)
    inputs = [f"x{i}" for i in range(len(parts))]
    if codes:
        names = [f"c{i}" for i in range(len(codes))]
        encoder = OneHotEncoder(inputCols=names, outputCols=[f"v_{c}" for c in names], dropLast=True)
        rows = encoder.fit(rows).transform(rows)
        inputs += [f"v_{c}" for c in names]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select("label", "features")


def fit_logistic(df: DataFrame, intercept: bool = True, max_iter: int = 200, tol: float = 1e-12,
                 reg: float = 0.0, elastic: float = 0.0) -> LogisticRegressionModel:
    """L-BFGS (or OWL-QN with an L1 part) over ``label, features``; no inner standardising."""
    return LogisticRegression(
        labelCol="label", featuresCol="features", fitIntercept=intercept, standardization=False,
        maxIter=max_iter, tol=tol, regParam=reg, elasticNetParam=elastic).fit(df)


def fit_elastic_net(df: DataFrame, max_iter: int = 100, reg: float = 0.3, elastic: float = 0.8) -> LogisticRegressionModel:
    return LogisticRegression(
        labelCol="label", featuresCol="features", maxIter=max_iter, regParam=reg,
        elasticNetParam=elastic).fit(df)


def model_coefficients(df: DataFrame, model: LogisticRegressionModel, terms: Sequence[str], intercept: bool) -> DataFrame:
    """``term, estimate`` of a fitted model; p rows."""
    rows = [("intercept", float(model.intercept))] if intercept else []
    rows += [(t, float(c)) for t, c in zip(terms, model.coefficients.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")


def model_loglik(df: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Log-likelihood of the fitted model from its predicted probabilities."""
    scored = model.transform(df)
    return loglik_from_prob(
        scored, "label", vector_item(F.col("probability"), 0), vector_item(F.col("probability"), 1))


@dataclass
class MlFit:
    """A Spark ML fit of a plan: the term list, the model and its log-likelihood over the rows it was fitted to."""

    spec: TermSpec
    model: LogisticRegressionModel
    coefficients: DataFrame
    loglik: DataFrame


def ml_job(df: DataFrame, plan: Plan, reg: float = 0.0, elastic: float = 0.0, max_iter: int = 200, tol: float = 1e-12) -> MlFit:
    """The whole job through Spark ML: select and collapse levels, code, scale, fit all rows at once, score.

    The same terms as the chunked job of the plan, so that both can be compared. With ``reg`` an elastic net.
    """
    if plan.keys:
        raise ValueError("Spark ML fits one model; use the chunked job for model keys")
    rows = prepare(df, plan)
    spec, _, _ = learn_spec(rows, plan)
    x = term_features(rows, spec).persist()
    model = fit_logistic(x, spec.intercept, max_iter, tol, reg, elastic)
    found = model_coefficients(x, model, spec.terms[int(spec.intercept):], spec.intercept)
    score = settle(model_loglik(x, model))
    x.unpersist()
    return MlFit(spec, model, found, score)
