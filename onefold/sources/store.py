"""Model store: a folder of Parquet tables in versions, so summaries can be extended and read anywhere.

Every save writes its tables below a folder of its own, and last of all one row of the manifest. Readers go by
the newest row, so a save that breaks off leaves the version before it untouched. The ledger names the slices of
data (files, batches) that a version holds: a slice that is given again adds nothing. Tables that only grow are added
to, not written again. One writer at a time: a save upon a version that is no longer the newest is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.spec import Factor, TermSpec

TABLES = ("summary", "combined", "path", "coef", "levels", "stats", "eval", "run", "unseen", "held", "ledger", "sketches")
# A table of more parts than this is written anew.
MAX_PARTS = 32


class Conflict(RuntimeError):
    """The model was saved by someone else since it was read, or holds part of the slices already."""


def _read_if_there(read):
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def newest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest row of the newest version, or None for a folder without versions."""
    rows = _read_if_there(lambda: spark.read.text(f"{folder}/manifest"))
    if rows is None:
        return None
    version = F.get_json_object("value", "$.version").cast("long")
    last = rows.groupBy(version.alias("version")).agg(F.collect_list("value").alias("rows")).orderBy(F.desc("version")).first()
    if last is None:
        return None
    if len(last["rows"]) > 1:
        raise Conflict(f"two saves of version {last['version']} in {folder}")
    return json.loads(last["rows"][0])


def save_table(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """One table outside of any version."""
    _known(name)
    df.write.mode(mode).parquet(f"{folder}/{name}")


def _known(name: str) -> None:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    _known(name)
    now = newest(spark, folder)
    if now is None:
        return spark.read.parquet(f"{folder}/{name}")
    return spark.read.parquet(*[f"{folder}/{part}" for part in now["tables"][name]])


def has_table(spark: SparkSession, folder: str, name: str) -> bool:
    _known(name)
    now = newest(spark, folder)
    return name in now["tables"] if now else _read_if_there(lambda: spark.read.parquet(f"{folder}/{name}")) is not None


def known_slices(spark: SparkSession, folder: str, slices: Iterable[str]) -> set[str]:
    """Those of the slices that the newest version holds."""
    asked = list(slices)
    if not asked or not has_table(spark, folder, "ledger"):
        return set()
    wanted = spark.createDataFrame([(s,) for s in asked], "slice string")
    found = load_table(spark, folder, "ledger").join(F.broadcast(wanted), "slice", "left_semi").select("slice").distinct()
    return {r["slice"] for r in found.collect()}


def append_summary(df: DataFrame, folder: str) -> None:
    """Add the chunk summaries of further data to a stored model, as a version of its own."""
    now = newest(df.sparkSession, folder)
    if now is None:
        save_table(df, folder, "summary", mode="append")
    else:
        save_model(folder, spec_from_dict(now["spec"]), base=now["version"], grown=("summary",), summary=df)


def write_parts(folder: str, **tables: DataFrame) -> dict[str, str]:
    """Write tables to a new folder that no manifest row names yet."""
    part = f"v-{uuid.uuid4().hex[:16]}"
    for name, df in tables.items():
        _known(name)
        df.write.parquet(f"{folder}/{part}/{name}")
    return {name: f"{part}/{name}" for name in tables}


def save_model(folder: str, spec: TermSpec, base: int | None = None, grown: Sequence[str] = (), slices: Sequence[str] = (),
               **tables: DataFrame) -> int:
    """Save a version and return its number.

    ``base`` is the version it extends: tables named in ``grown`` are added to that version's, those not given are
    kept from it, and the others replaced. ``slices`` go into the ledger.
    """
    spark = next(iter(tables.values())).sparkSession
    now = newest(spark, folder)
    if base is not None and (now is None or now["version"] != base):
        raise Conflict(f"version {base} of {folder} is no longer the newest")
    old = now["tables"] if base is not None else {}
    if slices:
        tables["ledger"] = spark.createDataFrame([(s,) for s in slices], "slice string").coalesce(1)
        grown = [*grown, "ledger"]
    for name in grown:
        if len(old.get(name, ())) >= MAX_PARTS:
            tables[name] = load_table(spark, folder, name).unionByName(tables[name])
    written = write_parts(folder, **tables)
    parts = dict(old)
    for name, part in written.items():
        add = name in grown and len(old.get(name, ())) < MAX_PARTS
        parts[name] = [*(old.get(name, []) if add else []), part]
    version = now["version"] + 1 if now else 1
    row = json.dumps({"version": version, "spec": spec_to_dict(spec), "tables": parts})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(f"{folder}/manifest")
    return version


def load_spec(spark: SparkSession, folder: str) -> TermSpec:
    now = newest(spark, folder)
    if now is None:
        raise FileNotFoundError(f"no model in {folder}")
    return spec_from_dict(now["spec"])


def spec_to_dict(spec: TermSpec) -> dict:
    return {
        "response": spec.response, "continuous": list(spec.continuous),
        "factors": [[f.name, list(f.levels), f.baseline] for f in spec.factors],
        "intercept": spec.intercept, "keys": list(spec.keys),
        "scales": {k: list(v) for k, v in spec.scales.items()},
    }


def spec_from_dict(d: dict) -> TermSpec:
    return TermSpec(
        d["response"], tuple(d["continuous"]),
        tuple(Factor(n, tuple(lv), b) for n, lv, b in d["factors"]),
        d["intercept"], tuple(d["keys"]), {k: tuple(v) for k, v in d["scales"].items()})


def save_stats_csv(stats: DataFrame, path: str) -> None:
    """Descriptive statistics as CSV; one row per column, so one file."""
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def load_stats_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=(
        "`col` string, n bigint, mean double, sd double, `min` double, `max` double"))


def run_row(df: DataFrame, spec: TermSpec) -> DataFrame:
    """Run metrics from a combined frame: rows, chunks, rows per chunk, number of terms."""
    return df.select(
        *spec.keys, "n_total", "n_used", "chunks_total", "chunks_used",
        (F.col("n_total") / F.col("chunks_total")).alias("rows_per_chunk"),
        F.lit(spec.p).cast("bigint").alias("terms"))
