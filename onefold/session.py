"""Session helpers: settings, the shared checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after it was counted and found to hold at most this many rows.
BROADCAST_ROWS = 200_000


def get_session(app: str = "onefold", **conf: str) -> SparkSession:
    """Session with the settings this package relies on; the master comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Not needed where it is installed on every node or was given with ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="onefold-code-"), "onefold.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables, seen by every executor.

    ``spark.checkpoint.dir`` of the session is used when set. A temporary folder
    is made only for a local master; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        # Spark appends a folder of its own per application; keep scratch tables beside it.
        return current.rstrip("/")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="onefold-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and cut its lineage.

    A lost executor then costs a re-read of the file, not a re-run of the plan,
    and values drawn by non-repeatable expressions stay fixed.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex[:12]}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as a Parquet scratch table and read it back.

    For a wide join used by several passes: each pass then reads the columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` holds at most ``limit`` rows; else leave the join to Catalyst.

    The count stops at ``limit + 1`` rows. Pass a settled or cached frame.
    """
    rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df
