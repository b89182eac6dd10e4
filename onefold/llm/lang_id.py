"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all learning rows in one pass of partial sums. The regression is
fitted with follow-the-regularised-leader and elastic-net penalties on a bounded sample per language
(``PER_LANGUAGE`` documents, whole texts), then its probabilities are calibrated with one temperature
on the part of the sample that was left out of the fit. Scoring reads every whole text once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onefold.llm.letters import gram_hashes, letters_of
from onefold.llm.packs import numbers
from onefold.llm.tokens import slices
from onefold.session import settle, stage

DIMS_BITS = 13
GRAMS = (1, 2, 3)
PER_LANGUAGE = 1500
# Documents laid out densely at once.
ROWS = 256
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    dims_bits: int = DIMS_BITS
    grams: tuple[int, ...] = GRAMS
    per_language: int = PER_LANGUAGE
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.02
    epochs: int = 4
    batch: int = 32
    held_share: float = 0.2


def gram_counts(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (texts x dims) and whether each text has a letter."""
    dims = 1 << s.dims_bits
    points, text = letters_of(texts)
    begins = np.cumsum(np.concatenate(([0], text[1:] != text[:-1]))) if len(text) else text
    out = np.zeros(len(texts) * dims, np.int64)
    for n in s.grams:
        hashes = gram_hashes(points, n)
        if not len(hashes):
            continue
        owner = text[:len(hashes)]
        cell = owner * dims + (hashes >> np.uint32(32 - s.dims_bits)).astype(np.int64)
        if n > 2:  # no text border inside the gram
            cell = cell[begins[n - 2:n - 2 + len(hashes)] == begins[:len(hashes)]]
        out += np.bincount(cell, minlength=len(out))
    has_letter = np.bincount(text[points != 32], minlength=len(texts)) > 0
    return out.reshape(len(texts), dims), has_letter


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, s: Settings) -> np.ndarray:
    """Weights (dims + 1 x classes, the last row the bias) from sparse rows of (places, values)."""
    dims = 1 << s.dims_bits
    z, n, w = (np.zeros((dims + 1, classes), np.float32) for _ in range(3))
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(s.epochs):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), s.batch):
            take = shuffled[at:at + s.batch]
            x = np.zeros((len(take), dims + 1), np.float32)
            x[:, dims] = 1
            for i, r in enumerate(take):
                x[i, rows[r][0]] = rows[r][1]
            error = softmax(x @ w)
            error[np.arange(len(take)), label[take]] -= 1
            g = x.T @ error
            grown = n + g * g
            z += g - (np.sqrt(grown) - np.sqrt(n)) / s.alpha * w
            n = grown
            l1, l2 = np.full((dims + 1, 1), s.l1, np.float32), np.full((dims + 1, 1), s.l2, np.float32)
            l1[dims] = l2[dims] = 0
            w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + l2)).astype(np.float32)
    return w


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by a shrinking search of its logarithm."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(label)), label], 1e-12)).mean())

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def _frequencies(s: Settings) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << s.dims_bits) + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                for lo in range(0, part.num_rows, ROWS):
                    counts, _ = gram_counts(part["text"].slice(lo, ROWS), s)
                    total[:-1] += (counts > 0).sum(0)
                    total[-1] += len(counts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["place", "n"])
    return run


def _sparse_rows(idf: np.ndarray, s: Settings) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for lo in range(0, part.num_rows, ROWS):
                    own = part.slice(lo, ROWS)
                    x = weighted(gram_counts(own["text"], s)[0], idf)
                    places, values = [], []
                    for row in x:
                        some = np.flatnonzero(row).astype(np.uint16)
                        places.append(some.tobytes())
                        values.append(row[some].astype(np.float32).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [own["lang"], own["draw"], pa.array(places, pa.binary()), pa.array(values, pa.binary())],
                        names=["lang", "draw", "places", "x"],
                    )
    return run


def _train(languages: list[str], s: Settings) -> Callable:
    def run(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("draw", "ascending"), ("lang", "ascending"), ("places", "ascending")])
        code = {lang: i for i, lang in enumerate(languages)}
        label = np.array([code[x] for x in sample["lang"].to_pylist()])
        rows = [(numbers(p, np.uint16), numbers(v, np.float32)) for p, v in zip(sample["places"], sample["x"], strict=True)]
        held = np.arange(len(rows)) % round(1 / s.held_share) == 0 if len(rows) >= 10 * len(languages) else np.zeros(len(rows), bool)
        fit = np.flatnonzero(~held)
        w = fit_ftrl([rows[i] for i in fit], label[fit], len(languages), s)
        rest = np.flatnonzero(held)
        logits = np.array([v @ w[p] + w[-1] for p, v in (rows[i] for i in rest)]).reshape(len(rest), len(languages))
        return pa.table({"weights": pa.array([w.tobytes()]), "temperature": pa.array([temperature(logits, label[rest])])})
    return run


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    settings: Settings

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        counts, has_letter = gram_counts(texts, self.settings)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        p = softmax((weighted(counts, self.idf) @ self.weights[:-1] + self.weights[-1]) / self.temperature)
        best = p.argmax(1)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)]
        return names, np.where(has_letter, p.max(1).astype(np.float64), 0.0)


def fit_languages(learn: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on the rows of ``learn`` (doc_id, text, lang) with a language and a text.

    Of each language at most ``per_language`` rows are drawn, each row by itself: rows with one doc_id, or equal
    rows, are drawn as often as others. The draw is stored with the sample.

    Languages, document frequencies and weights are of the size of the model, and collected.
    """
    rows = learn.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    dims = 1 << s.dims_bits
    if not languages:
        return Model([], np.zeros(dims, np.float32), np.zeros((dims + 1, 0), np.float32), 1.0, s)
    frequency = np.zeros(dims + 1, np.int64)
    for r in rows.select("text").mapInArrow(_frequencies(s), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        frequency[r["place"]] = r["n"]
    idf = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1).astype(np.float32)
    # A little more than the share that is needed, then the smallest draws of each language.
    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 1.2 * (s.per_language + 20) / counts[lang]))])
    sample = rows.withColumn("draw", F.floor(F.rand(9) * (1 << 60)).cast("long")).where(F.col("draw") < limit[F.col("lang")] * (1 << 60))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    sample = stage(sample, "draws").withColumn("place", place).where(F.col("place") <= s.per_language).drop("place")
    sample = settle(sample.mapInArrow(_sparse_rows(idf, s), "lang string, draw long, places binary, x binary"))
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInArrow(
        lambda t: _train(languages, s)(t), "weights binary, temperature double"
    ).first()
    if fitted is None:
        return Model([], idf, np.zeros((dims + 1, 0), np.float32), 1.0, s)
    w = np.frombuffer(bytes(fitted["weights"]), np.float32).reshape(dims + 1, len(languages))
    return Model(languages, idf, w, fitted["temperature"], s)


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, rest (its other columns but text), lang_pred, score.

    score is the calibrated probability of lang_pred. A null text or one without a letter is ``und``
    with score 0; so is every text where there was nothing to learn from. Repeated rows are rows of
    their own; an empty table gives an empty result.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), rest.alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for lo in range(0, part.num_rows, ROWS):
                    own = part.slice(lo, ROWS)
                    names, score = model.predict(own["text"])
                    yield pa.RecordBatch.from_arrays(
                        [own["doc_id"], own["text"], own["rest"], pa.array(names, pa.string()), pa.array(score)],
                        names=["doc_id", "text", "rest", "lang_pred", "score"],
                    )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "rest")}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, text string, rest {kinds['rest']}, lang_pred string, score double")
