"""Charts over the hourly views: argument rules, ranges, steps and look-back values."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import timeseries
from .timeseries import DAY, HOUR, MONTH, WEEK

STEPS = {"HOUR": HOUR, "DAY": DAY, "WEEK": WEEK, "MONTH": MONTH}
FORMATS = {"HOUR": "%Y-%m-%d %H:%M"}


def seconds_of(text: str | None, step: str) -> int | None:
    """Epoch seconds of a date, or of a date with hour and minute for hourly charts; ValueError for anything else."""
    if text is None:
        return None
    told = dt.datetime.strptime(text, FORMATS.get(step, "%Y-%m-%d")).replace(tzinfo=dt.timezone.utc)
    return int(told.timestamp())


def parse_range(start: str | None, end: str | None, step: str, now: int) -> tuple[int | None, int | None]:
    """(start, end) in seconds; start is cut down to a whole step. A range that is upside down is an error.

    An hourly end is cut to now only where a start is given.
    """
    if step not in STEPS:
        raise ValueError(f"no step {step}")
    lo, hi = seconds_of(start, step), seconds_of(end, step)
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("the range begins after its end")
    if step == "HOUR" and lo is not None and hi is not None:
        hi = min(hi, now)
    return None if lo is None else lo - lo % STEPS[step], hi


def _chart(view: DataFrame, value: str, step: str, start: int | None, end: int | None, how: str = "max") -> DataFrame:
    size = STEPS[step]
    points = view.select(F.col("hour").alias("moment"), value) if step == "HOUR" else timeseries.daily(view, value, how).select(F.col("day").alias("moment"), value)
    if end is not None:
        points = points.filter(F.col("moment") <= end)
    return timeseries.gap_fill(points, "moment", value, size, start=start, end=end)


def data_usage(history: DataFrame, step: str = "DAY", start: int | None = None, end: int | None = None) -> DataFrame:
    """Bytes stored at each step: the largest value of a day, the last value seen where there is none."""
    return _chart(timeseries.data_usage(history), "data_usage", step, start, end)


def entity_count(history: DataFrame, step: str = "DAY", start: int | None = None, end: int | None = None) -> DataFrame:
    return _chart(timeseries.entity_count(history), "total", step, start, end)


def operation_count(ops: DataFrame, step: str = "DAY", start: int | None = None, end: int | None = None, operation: str | None = None) -> DataFrame:
    """Operations at each step, carried over gaps: of one kind the largest hourly count, else the sum over all kinds."""
    view = timeseries.operation_count(ops)
    if operation is not None:
        return _chart(view.filter(F.col("operation") == operation).select("hour", "n"), "n", step, start, end)
    return _chart(view.groupBy("hour").agg(F.sum("n").cast("bigint").alias("n")), "n", step, start, end, "sum")


def storage_forecast(forecast: DataFrame, step: str, end: int | None = None) -> DataFrame:
    """Bytes still live from the forecast's first row on, by hour, day, week or month of 30 days."""
    return timeseries.forecast_periods(forecast, STEPS[step], until=end)
