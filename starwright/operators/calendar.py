"""Number helper and the date dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.functions.dates import as_date, calendar_columns
from starwright.schemas import NUMBERS_SIZE


def numbers(spark: SparkSession, n: int = NUMBERS_SIZE) -> DataFrame:
    """0 .. n-1 as ``number`` (the 10x10x10x10 digit cross join, re-aimed as
    a distributed range: no join, no LIMIT)."""
    return spark.range(n).select(F.col("id").alias("number"))


def numbers_small(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.col("id").cast("int").alias("number"))


def _to_date(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def date_dim(spark: SparkSession, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """One row per day of [start, end], keyed 0, 1, ... by day offset.

    Columns: date_key, date, timestamp, weekend, day_of_week, month,
    month_day, year, week_starting_monday."""
    lo, hi = _to_date(start), _to_date(end)
    days = (hi - lo).days + 1
    base = numbers(spark, max(days, 0)).select(
        F.col("number").alias("date_key"),
        F.date_add(as_date(lo), F.col("number").cast("int")).alias("date"),
    )
    return base.withColumns(calendar_columns(F.col("date")))


def calendar_bounds(dates: DataFrame, column: str) -> tuple[dt.date, dt.date]:
    """Whole-year calendar bounds covering a date/timestamp column:
    1 January of the first year to 31 December of the last year.

    Two scalars reach the driver (an aggregate), nothing else."""
    row = dates.agg(F.min(F.year(column)).alias("lo"), F.max(F.year(column)).alias("hi")).first()
    if row is None or row["lo"] is None:
        raise ValueError(f"no dates in column {column!r}")
    return dt.date(row["lo"], 1, 1), dt.date(row["hi"], 12, 31)
