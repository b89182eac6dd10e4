"""The flight-delay model: its file schema, predictors and settings, as a preset of the main job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from onefold.plans.regression import Fit, Plan, fit
from onefold.sources.csv import read_csv
from onefold.spec import OTHERS

# The columns of the public flight records 1987-2008, in file order.
FLIGHT_SCHEMA = (
    "Year int, Month int, DayofMonth int, DayOfWeek int, DepTime double, CRSDepTime double, "
    "ArrTime double, CRSArrTime double, UniqueCarrier string, FlightNum string, TailNum string, "
    "ActualElapsedTime double, CRSElapsedTime double, AirTime double, ArrDelay double, DepDelay double, "
    "Origin string, Dest string, Distance double, TaxiIn double, TaxiOut double, Cancelled int, "
    "CancellationCode string, Diverted int, CarrierDelay double, WeatherDelay double, NASDelay double, "
    "SecurityDelay double, LateAircraftDelay double"
)

# Predictors, shares of levels to keep, and the levels that get no term.
CONTINUOUS = ("ActualElapsedTime", "CRSArrTime", "CRSDepTime", "DayofMonth", "DepTime", "Distance", "Year")
KEEP_TOP = {"Month": 1.0, "DayOfWeek": 1.0, "UniqueCarrier": 0.8, "Origin": 0.9, "Dest": 0.9}
BASELINE = {"Month": "1", "DayOfWeek": "1", "UniqueCarrier": OTHERS, "Origin": OTHERS, "Dest": OTHERS}


def flight_plan(**changes) -> Plan:
    settings = {
        "response": "ArrDelay", "continuous": CONTINUOUS, "keep_top": KEEP_TOP, "baseline": BASELINE,
        "intercept": True, "rows_per_chunk": 1_000_000,
    }
    return Plan(**{**settings, **changes})


def read_flights(spark: SparkSession, paths) -> DataFrame:
    return read_csv(spark, paths, FLIGHT_SCHEMA)


def fit_flights(spark: SparkSession, paths, **changes) -> Fit:
    return fit(read_flights(spark, paths), flight_plan(**changes))
