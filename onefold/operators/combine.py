"""Combining chunk summaries: the single communication round.

Summaries add up, so those of new files are appended to stored ones and combined again
without touching old rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.operators.chunkfit import sum_arrays
from onefold.operators.newton import newton_step, unpack
from onefold.spec import TermSpec

_SOLVED = (
    "n_total bigint, n_used bigint, chunks_total bigint, chunks_used bigint, "
    "wlse array<double>, one_shot array<double>, hess array<double>, estimable array<boolean>, aside array<double>"
)


# Status of an entry that takes rows back from stored summaries, to be fitted anew.
RETURNED = "returned"


def append_summaries(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def combine(summaries: DataFrame, spec: TermSpec) -> DataFrame:
    """One row per model: the Hessian-weighted (WLSE) and the plain (one-shot) average.

    Only chunks with status ``ok`` count; totals over all chunks are reported beside them.
    ``hess`` is the summed Hessian, upper triangle. Models without any usable chunk get nulls.
    The one-shot average of a term is over the chunks that have rows for it. A term without
    information in any chunk is not ``estimable``: its estimate is 0. ``aside`` counts the rows of
    each term that were set aside because they are separated in their chunk: a level of one class throughout
    is not estimable and has all its rows there.
    """
    keys = list(spec.keys)
    p = spec.p
    diagonal = F.array(*[F.lit(i * p - i * (i - 1) // 2 + 1) for i in range(p)])
    aside = F.coalesce(F.col("aside"), F.array_repeat(F.lit(0.0), p))
    present = F.zip_with(diagonal, aside, lambda i, a: F.when((F.element_at("hess", i) > 0) & (a == 0), 1.0).otherwise(0.0))
    # Entries of returned rows take rows that were set aside out of the counts; they are no chunks.
    returned = F.col("status") == RETURNED
    ok = (F.col("status") == "ok") | returned
    n, chunk = F.col("n").cast("double"), F.when(returned, 0.0).otherwise(1.0)
    counts = F.array(n, F.when(ok, n).otherwise(0.0), chunk, F.when(ok, chunk).otherwise(0.0))
    vector = F.when(ok, F.concat(counts, "theta", "v", present, aside, "hess")).otherwise(counts)
    # Partial sums per task leave at most 4 + 4p + p(p+1)/2 cells per model and task to shuffle.
    summed = sum_arrays(summaries, keys, vector, "sums").filter(F.size("sums") > 0)
    types = {f.name: f.dataType.simpleString() for f in summaries.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], _SOLVED])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                s = np.asarray(row["sums"], float)
                head = [row[k] for k in keys] + [int(x) for x in s[:4]]
                if s[3] == 0:
                    out.append([*head, None, None, None, None, None])
                    continue
                theta, v, seen, away = s[4: 4 + 4 * p].reshape(4, p)
                h = s[4 + 4 * p:]
                wlse = newton_step(v, unpack(h, p))
                out.append([*head, wlse, theta / np.maximum(seen, 1.0), h, seen > 0, away])
            yield pd.DataFrame(out, columns=[*keys, *_SOLVED_NAMES])

    return summed.mapInPandas(solve, schema)


_SOLVED_NAMES = ["n_total", "n_used", "chunks_total", "chunks_used", "wlse", "one_shot", "hess", "estimable", "aside"]


def coefficients(frame: DataFrame, spec: TermSpec, methods: dict[str, str]) -> DataFrame:
    """Long coefficient table ``keys, term, method, estimate`` from array columns.

    ``methods`` maps a method name to the array column holding its estimate.
    """
    terms = F.array(*[F.lit(t) for t in spec.terms])
    named = F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(c).alias("values")) for m, c in methods.items()
    ])
    per_method = frame.select(*spec.keys, F.inline(named))
    return per_method.select(
        *spec.keys, "method",
        F.inline(F.arrays_zip(terms.alias("term"), F.col("values").alias("estimate"))),
    ).select(*spec.keys, "term", "method", "estimate")


def coefficients_wide(long: DataFrame, spec: TermSpec, methods: list[str]) -> DataFrame:
    """One row per term, one column per method."""
    return long.groupBy(*spec.keys, "term").pivot("method", methods).agg(F.first("estimate"))


def summary_terms(summaries: DataFrame, spec: TermSpec) -> DataFrame:
    """Chunk summaries in long form: ``keys, partition_id, n, term, theta, v, h`` (h on the diagonal)."""
    p = spec.p
    diagonal = [i * p - i * (i - 1) // 2 + 1 for i in range(p)]
    cells = F.array(*[
        F.struct(F.lit(t).alias("term"), F.element_at("theta", i + 1).alias("theta"),
                 F.element_at("v", i + 1).alias("v"), F.element_at("hess", diagonal[i]).alias("h"))
        for i, t in enumerate(spec.terms)
    ])
    return summaries.filter(F.col("status") == "ok").select(
        *spec.keys, "partition_id", "n", F.inline(cells))


def summary_matrix(summaries: DataFrame, spec: TermSpec) -> DataFrame:
    """Chunk summaries as p rows of p columns: ``keys, partition_id, par_id, coef, moment, <terms>``."""
    keys, p, terms = list(spec.keys), spec.p, spec.terms
    types = {f.name: f.dataType.simpleString() for f in summaries.schema.fields}
    schema = ", ".join([
        *[f"`{k}` {types[k]}" for k in keys], "partition_id bigint, par_id int, coef double, moment double",
        *[f"`{t}` double" for t in terms]])

    def lay_out(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                out = pd.DataFrame(unpack(np.asarray(row["hess"], float), p), columns=terms)
                head = {k: row[k] for k in [*keys, "partition_id"]}
                head.update(par_id=range(p), coef=row["theta"], moment=row["v"])
                for at, (name, value) in enumerate(head.items()):
                    out.insert(at, name, value)
                yield out

    ok = summaries.filter(F.col("status") == "ok")
    return ok.select(*keys, "partition_id", "theta", "v", "hess").mapInPandas(lay_out, schema)
