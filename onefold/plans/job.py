"""Command line of the main job, for spark-submit.

    spark-submit --py-files onefold.zip onefold/plans/job.py --format parquet --input PATH \\
        --response y --continuous a,b --factors f=0.9,g=1.0 --baseline first --out MODEL
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from onefold.plans.flights import flight_plan, read_flights
from onefold.plans.ml import MlFit, ml_job
from onefold.plans.regression import Fit, Plan, extend, fit
from onefold.session import get_session, ship_code
from onefold.sources.csv import read_csv
from onefold.sources.store import known_slices
from onefold.spec import MAX_TERMS


def _names(text: str) -> list[str]:
    return [t for t in text.split(",") if t]


def parse(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Fit a logistic regression per chunk and combine the fits.")
    p.add_argument("--input", required=True, type=_names, help="files or folders, comma separated")
    p.add_argument("--format", choices=["parquet", "csv", "flights"], default="parquet")
    p.add_argument("--schema", help="DDL of the CSV columns")
    p.add_argument("--response")
    p.add_argument("--continuous", type=_names, default=[])
    p.add_argument("--factors", type=_names, default=[], help="name=share to keep, comma separated")
    p.add_argument("--baseline", help="none, first, last, or factor=level pairs, comma separated (default: first)")
    p.add_argument("--no-intercept", action="store_true")
    p.add_argument("--min-share", type=float, help="also keep levels with this share of the rows")
    p.add_argument("--threshold", type=float, default=0.0, help="the response counts as 1 above it")
    p.add_argument("--max-terms", type=int, default=MAX_TERMS)
    p.add_argument("--unseen", choices=["leave_out", "error"], default="leave_out", help="rows of levels that a model to extend does not have")
    p.add_argument("--keys", type=_names, default=[], help="one model per value of these columns")
    p.add_argument("--row-key", type=_names, default=[])
    p.add_argument("--rows-per-chunk", type=int, default=1_000_000)
    p.add_argument("--kind", choices=["lar", "lasso"], default="lar")
    p.add_argument("--in-place", action="store_true", help="cut chunks from the scan, shuffle no row")
    p.add_argument("--method", choices=["chunks", "spark-ml"], default="chunks", help="spark-ml fits all rows at once")
    p.add_argument("--reg", type=float, default=0.0, help="elastic-net penalty of spark-ml")
    p.add_argument("--elastic", type=float, default=0.0, help="its share of the absolute part")
    p.add_argument("--extend", help="folder of a stored model to extend by the input")
    p.add_argument("--out", help="folder to store the model in")
    return p.parse_args(args)


def run(spark, o: argparse.Namespace) -> tuple[Fit | MlFit | None, list[str]]:
    """The fit and the files it read; None where a model to extend has them all."""
    shared = {"keys": o.keys, "row_key": o.row_key, "rows_per_chunk": o.rows_per_chunk, "kind": o.kind, "in_place": o.in_place,
              "min_share": o.min_share, "threshold": o.threshold, "max_terms": o.max_terms, "unseen": o.unseen}
    if o.no_intercept:
        shared["intercept"] = False
    if o.baseline:
        pairs = dict(x.split("=", 1) for x in o.baseline.split(",") if "=" in x)
        shared["baseline"] = pairs or o.baseline
    if o.format == "flights":
        rows, plan = read_flights(spark, o.input), flight_plan(**shared)
    else:
        rows = read_csv(spark, o.input, o.schema) if o.format == "csv" else spark.read.parquet(*o.input)
        keep = {name: float(share) for name, share in (f.split("=") for f in o.factors)}
        plan = Plan(o.response, o.continuous, keep, **{"baseline": "first", **shared})
    if o.method == "spark-ml":
        return ml_job(rows, plan, o.reg, o.elastic), rows.inputFiles()
    if not o.extend:
        return fit(rows, plan), rows.inputFiles()
    # Files that the model holds already are not read again.
    files = rows.inputFiles()
    known = known_slices(spark, o.extend, files)
    new = [f for f in files if f not in known]
    if known and new:
        rows = rows.filter(F.input_file_name().isin(new)) if o.format != "parquet" else spark.read.parquet(*new)
    return extend(rows, plan, o.extend, new or files), new


def main() -> None:
    options = parse()
    spark = get_session("onefold-fit")
    ship_code(spark)
    result, files = run(spark, options)
    if options.method == "spark-ml":
        result.loglik.show(truncate=False)
        result.coefficients.show(len(result.spec.terms), truncate=False)
    elif result is None:
        print("nothing new: the model has all of these files")
    else:
        if options.out:
            result.save(options.out, files)
        result.report()
        result.close()
    spark.stop()


if __name__ == "__main__":
    main()
