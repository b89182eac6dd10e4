"""Headline queries, timed one by one; prints one JSON line.

One query runs unmeasured first, so that the session and the Python workers are up; then each
query is measured once with its result written to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from onefold.catalog import io, levels, models, relational  # noqa: E402
from onefold.session import ship_code  # noqa: E402

HEADLINE = [
    "clean_job", "describe_stats", "level_select_strict", "collapse_levels", "factor_codes", "onehot_vector",
    "chunk_by_position", "group_demean", "group_ols_supplier", "chunk_fit_cells", "combine_wlse",
    "combine_by_segment", "chunk_fit_dense_check", "fit_in_place_check", "shrink_path", "loglik_multi",
    "main_job", "predict_prob", "ml_logistic_saturated", "lbfgs_cells", "sgd_averaged", "csv_roundtrip",
    "model_roundtrip",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_code(spark)
    every = {name: fn for m in (relational, levels, models, io) for name, fn in m.QUERIES.items()}
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()

    def run(name: str) -> float:
        start = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("chunk_fit_cells")
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "lineitem_rows": rows,
        "rows_per_sec": {name: round(rows / s) for name, s in seconds.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
