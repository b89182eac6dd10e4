"""Row preparation: projection, null filter, response, standardising, the design columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onefold.functions import standardise, term_name
from onefold.session import BROADCAST_ROWS, small_side
from onefold.spec import INTERCEPT, OTHERS, Factor, TermSpec

# Up to this many levels a code is found by a literal array search, above by a hash join.
INLINE_LEVELS = 16


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null or NaN in the given columns.

    ``dropna`` makes one opaque predicate of it; single conditions are pushed to the scan.
    """
    kinds = dict(df.dtypes)
    keep = F.lit(True)
    for c in dict.fromkeys(columns):
        keep = keep & F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            keep = keep & ~F.isnan(c)
    return df.filter(keep)


def project(df: DataFrame, columns: Sequence[str], dropna: bool = True) -> DataFrame:
    """Keep the used columns; drop rows with a null or NaN in any of them.

    The filter is placed on the scan, so Parquet gets ``IsNotNull`` predicates and
    reads these columns only.
    """
    out = df.select(*columns)
    return drop_missing(out, columns) if dropna else out


def complete_rows(df: DataFrame, spec: TermSpec) -> DataFrame:
    """Rows without a null in the response, a predictor or a model key."""
    return drop_missing(df, [spec.response, *spec.continuous, *[f.name for f in spec.factors], *spec.keys])


def binarise(df: DataFrame, column: str, threshold: float = 0.0, into: str | None = None) -> DataFrame:
    """1 where the column is above the threshold, else 0."""
    hit = F.when(F.col(column) > threshold, 1).otherwise(0)
    return df.withColumn(into or column, hit)


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of the given numeric columns become 0."""
    return df.fillna(0, subset=list(columns))


def standardise_columns(df: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Replace each column by (x - mean) / sd; the statistics are p pairs held as literals."""
    return df.withColumns({c: standardise(F.col(c), m, s) for c, (m, s) in scales.items()})


def _collapsed(factor: Factor) -> Column:
    """Level as text, with every level that was not kept replaced by ``OTHERS``."""
    text = F.col(factor.name).cast("string")
    if OTHERS not in factor.levels:
        return text
    kept = [lv for lv in factor.levels if lv != OTHERS]
    return F.when(text.isin(kept), text).otherwise(F.lit(OTHERS))


def dummy_columns(df: DataFrame, spec: TermSpec) -> DataFrame:
    """Append one 0/1 column per factor term; complete by construction, absent levels are 0.

    A level that the factor does not have, without ``OTHERS`` to take it, gives nulls: it is not
    the baseline.
    """
    new: dict[str, Column] = {}
    for factor in spec.factors:
        text = _collapsed(factor)
        for level, term in zip(factor.slots, factor.terms, strict=True):
            new[term] = F.when(text == level, 1).when(text.isin(list(factor.levels)), 0)
    return df.withColumns(new) if new else df


def design_columns(df: DataFrame, spec: TermSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Wide design matrix: the ``keep`` columns, the response, then the terms in term order."""
    out = dummy_columns(df, spec)
    out = standardise_columns(out, {c: s for c, s in spec.scales.items() if c in spec.continuous})
    if spec.intercept:
        out = out.withColumn(INTERCEPT, F.lit(1.0))
    return out.select(*keep, spec.response, *[F.col(f"`{t}`") for t in spec.terms])


def clean(df: DataFrame, spec: TermSpec, keep: Sequence[str] = ()) -> DataFrame:
    """The whole cleaning job: project, drop nulls, collapse, expand, standardise, 0/1 response."""
    used = [spec.response, *spec.continuous, *[f.name for f in spec.factors], *keep]
    rows = project(df, list(dict.fromkeys(used)))
    return binarise(design_columns(rows, spec, keep), spec.response)


def add_codes(df: DataFrame, spec: TermSpec) -> DataFrame:
    """Append ``code_<factor>``: the term position in the factor, or its width for the baseline level.

    A level that the factor does not have goes to ``OTHERS`` if there is one; else its code is null.

    Codes stand for dummies everywhere downstream: one narrow int per factor is
    shuffled and sent to Python, whatever the number of levels.
    """
    out = df
    for factor in spec.factors:
        out = _add_code(out, factor)
    return out


def _add_code(df: DataFrame, factor: Factor) -> DataFrame:
    slots = factor.slots
    none = len(slots)
    unseen = F.lit(slots.index(OTHERS) if OTHERS in slots else none if OTHERS == factor.baseline else None).cast("int")
    known = [*slots, factor.baseline] if factor.baseline is not None else list(slots)
    text = F.col(factor.name).cast("string")
    name = f"code_{factor.name}"
    if len(known) <= INLINE_LEVELS:
        at = F.array_position(F.array(*[F.lit(lv) for lv in known]), text).cast("int")
        return df.withColumn(name, F.when(at > 0, at - 1).when(text.isNotNull(), unseen))
    # The lookup side has as many rows as the factor has kept levels, bounded by the spec.
    lookup = df.sparkSession.createDataFrame(
        [(lv, i) for i, lv in enumerate(known)], f"`__level` string, `{name}` int"
    )
    lookup = F.broadcast(lookup) if len(known) <= BROADCAST_ROWS else lookup
    joined = df.join(lookup, text == F.col("__level"), "left").drop("__level")
    return joined.withColumn(name, F.coalesce(F.col(name), F.when(text.isNotNull(), unseen)))


def add_level_codes(df: DataFrame, slots: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Append ``code_<factor>`` from a frame of ``levels.level_slots``, for factors with more levels than a term list may hold.

    As in ``add_codes`` a level that the factor does not have goes to ``OTHERS`` if there is one; else its code is null.
    The slots are used more than once; pass a settled frame.
    """
    # One row per factor at most comes back.
    others = {r["factor"]: r["slot"] for r in slots.filter(F.col("level") == OTHERS).collect()}
    out = df
    for name in factors:
        code = f"code_{name}"
        own = slots.filter(F.col("factor") == name).select(F.col("level").alias("__level"), F.col("slot").alias(code))
        text = F.col(name).cast("string")
        out = out.join(small_side(own), text == F.col("__level"), "left").drop("__level")
        unseen = F.lit(others.get(name)).cast("int")
        out = out.withColumn(code, F.coalesce(F.col(code), F.when(text.isNotNull(), unseen)))
    return out


def coded(df: DataFrame, spec: TermSpec) -> DataFrame:
    """Rows with codes, without those of an unseen level; ``unseen_rows`` counts what this leaves out."""
    out = add_codes(df, spec)
    for factor in spec.factors:
        out = out.filter(F.col(f"code_{factor.name}").isNotNull())
    return out


def unseen_rows(df: DataFrame, spec: TermSpec) -> DataFrame:
    """``factor, level, n``: rows with a level that the term list neither has nor collapses."""
    parts = None
    for factor in spec.factors:
        if OTHERS in factor.levels:
            continue
        text = F.col(factor.name).cast("string")
        own = df.filter(text.isNotNull() & ~text.isin(list(factor.levels))).groupBy(text.alias("level")).agg(F.count(F.lit(1)).alias("n"))
        own = own.select(F.lit(factor.name).alias("factor"), "level", "n")
        parts = own if parts is None else parts.unionByName(own)
    return parts if parts is not None else df.sparkSession.createDataFrame([], "factor string, level string, n bigint")


def collapse_levels(df: DataFrame, levels: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Replace rare levels by ``OTHERS`` through a left join with the kept levels.

    For factors whose kept levels are too many for a literal list. The kept side is
    broadcast only after its size was checked; otherwise it is a shuffle join, whose
    hot level adaptive execution splits on the data side.
    """
    out = df
    for name in factors:
        kept = levels.filter((F.col("factor") == name) & F.col("kept")).select(
            F.col("level").alias("__kept")
        )
        kept = small_side(kept)
        out = (
            out.join(kept, F.col(name).cast("string") == F.col("__kept"), "left")
            .withColumn(name, F.coalesce(F.col("__kept"), F.lit(OTHERS)))
            .drop("__kept")
        )
    return out


def level_terms(df: DataFrame, factor: str) -> DataFrame:
    """Append the term name of a row's level."""
    return df.withColumn("term", term_name(factor, F.col(factor).cast("string")))
