"""Extending a model as files arrive: chunk summaries per micro-batch, added to the store.

Summaries add up, so new files are fitted alone; stored rows are not read again, save those that were held
back because their batch could not tell their level's effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.operators.chunkfit import fit_chunks
from onefold.plans.regression import Plan, extend, fit
from onefold.sources import store
from onefold.spec import TermSpec


def model_sink(plan: Plan, folder: str, spec: TermSpec | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """A ``foreachBatch`` function that keeps a stored model up to date.

    The first batch makes the model (with the terms of ``spec``, or its own) and every later one extends it. The model's version is the state: summaries,
    rows held back and the batch's name in the ledger are committed by one manifest row, so a batch that is run again after a failure
    adds nothing, and rows of a batch without an optimum wait for the batches after it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"batch-{batch_id}"
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        rows = prepare(batch) if prepare else batch
        started = store.newest(spark, folder) is not None
        out = extend(rows, plan, folder, [name]) if started else fit(rows, plan, spec=spec)
        if out is not None:
            with out:
                out.save(folder, [name])

    return write


def stream_model(stream: DataFrame, plan: Plan, folder: str, checkpoint: str, spec: TermSpec | None = None,
                 prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Start the query for the files present now; call again when more have arrived."""
    return (
        stream.writeStream.foreachBatch(model_sink(plan, folder, spec, prepare))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def summary_sink(spec: TermSpec, path: str, chunk: Callable[[DataFrame], DataFrame]):
    """A ``foreachBatch`` function writing the summaries of a batch to ``path``.

    Each batch has its own folder and overwrites it, so a batch that is run again after a
    failure leaves one copy. ``chunk`` gives a batch its chunk numbers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        summary = fit_chunks(chunk(batch), spec)
        summary.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stream_summaries(stream: DataFrame, spec: TermSpec, path: str, checkpoint: str,
                     chunk: Callable[[DataFrame], DataFrame]):
    """Start the query for the files present now; call again when more have arrived."""
    return (
        stream.writeStream.foreachBatch(summary_sink(spec, path, chunk))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_summaries(spark, path: str) -> DataFrame:
    """All summaries written so far, with the batch that wrote them."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("bigint"))
