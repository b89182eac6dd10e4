"""A corpus in five stages: language, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.llm.decontaminate import contained_items
from onefold.llm.lang_id import UNDETERMINED, fit_languages, predict_languages
from onefold.llm.near_dup import near_duplicates
from onefold.llm.packing import pack_documents
from onefold.llm.substring_dedup import remove_repeats, restored
from onefold.session import settle, ship_code, small_side, stage

# Probability below which a language counts as not identified.
MIN_LANGUAGE_SCORE = 0.4


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identifiable language; those without a letter or with a score below the minimum go.

    Learned as in op9 from the given languages. Where no row has one, all texts with a letter stay.
    """
    ship_code(spark)
    learn = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "text", "lang")
    model = fit_languages(learn)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict_languages(docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    own = ("doc_id", "text")
    return found.select(*[F.col(c) if c in own else F.col("rest").getField(c).alias(c) for c in docs.columns])


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates; one row of each doc_id.

    Rows without doc_id stay.
    """
    ship_code(spark)
    found = settle(near_duplicates(docs).select("doc_id", "kept"))
    gone = small_side(settle(found.where("NOT kept").select("doc_id").distinct()))
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = settle(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.take(1):
        return left.select(*_columns(docs))
    repeated = small_side(repeated)
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").select(*_columns(docs)).unionByName(once.select(*_columns(docs)))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that start in an earlier one; a text that loses nothing is unchanged."""
    ship_code(spark)
    return restored(remove_repeats(docs, untouched=True), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_code(spark)
    leaks = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = small_side(settle(leaks.select("doc_id").distinct()))
    return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 4,096 words from all remaining documents."""
    ship_code(spark)
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_dup", near_dup),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The stages fit a model and form components, which SQL cannot express.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
