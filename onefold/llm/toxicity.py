"""Toxicity by non-negative positive-unlabelled learning.

Learning sees confirmed toxic texts and unlabelled texts only. The risk of a linear classifier is
``prior * P(loss as toxic) + max(0, U(loss as clean) - prior * P(loss as clean))``: the clean part of
the unlabelled texts is estimated by taking the toxic share off, and kept from falling below zero,
where the fit would only memorise the toxic texts. Several classifiers are trained in parallel tasks,
each on all sampled toxic texts and a part of the sampled unlabelled ones; scores are averaged.

The sample is bounded by ``Settings``; whole texts are read. The prior is counted over all labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.llm.letters import letter_words
from onefold.llm.packs import numbers
from onefold.llm.tokens import slices
from onefold.session import settle, small_side


@dataclass(frozen=True)
class Settings:
    bits: int = 20  # of the word hash that number a feature
    toxic_rows: int = 3000
    unlabelled_rows: int = 9000
    parts: int = 3  # classifiers
    features: int = 1000  # kept by each at most
    least_rows: int = 8  # sampled toxic texts a feature is in, at least
    least_precision: float = 0.3
    steps: int = 500
    rate: float = 0.2
    l2: float = 1e-5


def text_features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of the letter words, sorted by text."""
    hashes, text = letter_words(texts)
    pairs = np.unique((text.astype(np.int64) << bits) | (hashes >> np.uint64(64 - bits)).astype(np.int64))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def chosen_features(toxic: list[np.ndarray], other: list[np.ndarray], prior: float, s: Settings) -> np.ndarray:
    """Features that alone make a text likely toxic, the most frequent first if there are too many.

    By Bayes' rule a text with the feature is toxic with probability ``prior * p / q``, p and q its
    shares in the toxic and the unlabelled sample; it is kept where this, with p and q moved
    against it by two standard errors, is still ``least_precision``.
    """
    size = 1 << s.bits
    a, b = (np.bincount(np.concatenate(x) if x else np.zeros(0, np.int64), minlength=size).astype(float) for x in (toxic, other))
    p, q = np.maximum(a - 2 * np.sqrt(a), 0) / max(1, len(toxic)), (b + 2 * np.sqrt(b) + 1) / max(1, len(other))
    kept = np.flatnonzero((a >= s.least_rows) & (prior * p / q >= s.least_precision))
    return np.sort(kept[np.argsort(-a[kept], kind="stable")[:s.features]])


def _dense(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, row in enumerate(rows):
        if len(features):
            at = np.minimum(np.searchsorted(features, row), len(features) - 1)
            x[i, at[features[at] == row]] = 1
    return x


def fit_nnpu(toxic: np.ndarray, other: np.ndarray, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias with a small non-negative risk, by Adam steps on the logistic loss.

    Every step uses the whole sample: in small batches the number of toxic texts among the
    unlabelled varies so much that the estimate of the clean part falls below zero by chance.
    """
    size = toxic.shape[1] + 1
    w, m, v = (np.zeros(size, np.float32) for _ in range(3))
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    for t in range(1, s.steps + 1):
        fp, fu = sigmoid(toxic @ w[:-1] + w[-1]), sigmoid(other @ w[:-1] + w[-1])
        # Logistic loss as toxic: -log f; as clean: -log(1 - f). The last place is the bias.
        clean = -np.log(np.maximum(1 - fu, 1e-9)).mean() + prior * np.log(np.maximum(1 - fp, 1e-9)).mean()
        error = (fu / len(fu), -prior * fp / len(fp))
        if clean < 0:
            error = (-error[0], -error[1])
        else:
            error = (error[0], error[1] - prior * (1 - fp) / len(fp))
        slope = np.append(error[0] @ other + error[1] @ toxic, error[0].sum() + error[1].sum())
        slope[:-1] += s.l2 * w[:-1]
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope * slope
        rate = s.rate * (1 - (t - 1) / s.steps)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(np.float64), float(w[-1])


def _features(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, feature = text_features(part["text"], bits)
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                each = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["part"], part["toxic"], part["draw"], pa.array(each, pa.binary())], names=["part", "toxic", "draw", "words"]
                )
    return run


def _train(prior: float, s: Settings) -> Callable:
    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("draw", "ascending"), ("words", "ascending")])
        part = sample["part"][0].as_py()
        rows = [numbers(x, np.int32).astype(np.int64) for x in sample["words"]]
        is_toxic = sample["toxic"].to_pylist()
        toxic, other = [r for r, t in zip(rows, is_toxic, strict=True) if t], [r for r, t in zip(rows, is_toxic, strict=True) if not t]
        features = chosen_features(toxic, other, prior, s)
        w, bias = np.zeros(len(features)), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        if toxic and other:
            w, bias = fit_nnpu(_dense(toxic, features), _dense(other, features), prior, s)
        kept = w != 0
        return pa.table({
            "part": pa.array([part], pa.int32()), "features": pa.array([features[kept].astype(np.int64).tobytes()]),
            "weights": pa.array([w[kept].tobytes()]), "bias": pa.array([bias]),
        })
    return run


@dataclass(frozen=True)
class Model:
    parts: list[tuple[np.ndarray, np.ndarray, float]]  # features, weights, bias
    prior: float
    settings: Settings

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.parts:
            return np.full(len(texts), self.prior)
        text, feature = text_features(texts, self.settings.bits)
        total = np.zeros(len(texts))
        for features, weights, bias in self.parts:
            at = np.minimum(np.searchsorted(features, feature), max(len(features) - 1, 0))
            value = np.where(features[at] == feature, weights[at], 0) if len(features) else np.zeros(len(feature))
            total += sigmoid(np.bincount(text, weights=value, minlength=len(texts)) + bias)
        return total / len(self.parts)


def fit_toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both of learning rows only.

    Toxic rows are those labelled 1; every row of ``docs``, whatever its label, may be drawn as
    unlabelled. At most ``toxic_rows`` and about ``unlabelled_rows`` rows are drawn, each by itself: of rows with one doc_id
    some may be drawn and others not. Draws are stored with the sample. The prior is the share of 1 among all labels (0.5 per cent at least, 1 per cent
    where there is none). Weights and features are of the size of the model, and collected.
    """
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = named.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    prior = min(0.995, max(0.005, counted[1] / counted[0])) if counted[0] else 0.01
    total = docs.count()
    if not total or not counted[1]:
        return Model([], prior, s)
    named = named.where("toxic = 1").withColumn("draw", F.xxhash64(F.lit(11), "doc_id"))
    ids = settle(named.orderBy("draw", "doc_id").limit(s.toxic_rows).select("doc_id"))
    drawn = docs.select("doc_id", "text", F.floor(F.rand(11) * (1 << 60)).cast("long").alias("draw"))
    rows = drawn.where("doc_id IS NOT NULL")
    schema = "part int, toxic boolean, draw long, words binary"
    toxic = rows.join(small_side(ids), "doc_id", "left_semi").select("text", "draw", F.lit(True).alias("toxic"), F.lit(0).alias("part"))
    toxic = toxic.mapInArrow(_features(s.bits), schema).orderBy("draw").limit(s.toxic_rows)
    toxic = toxic.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(s.parts - 1))))
    other = drawn.where(F.col("draw") < min(1.0, s.unlabelled_rows / total) * (1 << 60)).select(
        "text", "draw", F.lit(False).alias("toxic"), F.pmod(F.xxhash64(F.lit(5), "draw"), F.lit(s.parts)).cast("int").alias("part")
    )
    sample = settle(toxic.unionByName(other.mapInArrow(_features(s.bits), schema)))
    fitted = sample.groupBy("part").applyInArrow(_train(prior, s), "part int, features binary, weights binary, bias double")
    parts = [
        (np.frombuffer(bytes(r["features"]), np.int64), np.frombuffer(bytes(r["weights"]), np.float64), r["bias"])
        for r in sorted(fitted.collect(), key=lambda r: r["part"])
    ]
    return Model(parts, prior, s)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted (1 if score >= 0.5) for every row of ``docs``.

    A null or empty text has the score of a text without words. Where there was nothing to learn
    from, every score is the prior. Repeated rows are rows of their own, other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.scores(part["text"])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
