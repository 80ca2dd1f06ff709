"""Calendar attributes (day names, ISO week, epoch seconds, month start)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from starwright.schemas import WEEKDAY_LABEL, WEEKEND_DAYS, WEEKEND_LABEL


def as_date(value: str | dt.date | Column) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value)


def epoch_seconds(d: Column) -> Column:
    """Seconds since 1970-01-01 of midnight UTC of date ``d``.

    Pure day arithmetic, so it does not depend on the session time zone."""
    return (F.datediff(d, F.lit(dt.date(1970, 1, 1))).cast("long") * F.lit(86400)).cast("long")


def iso_week(d: Column) -> Column:
    """ISO-8601 week number (weeks start on Monday) as two characters."""
    return F.lpad(F.weekofyear(d).cast("string"), 2, "0")


def month_start(d: Column) -> Column:
    """First day of the month as a DATE.

    ``trunc`` keeps the DATE type; ``date_trunc`` would return a zoned
    timestamp for TIMESTAMP_NTZ input."""
    return F.trunc(F.to_date(d), "month")


def day_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def calendar_columns(d: Column) -> dict[str, Column]:
    """The derived columns of the date dimension for a DATE column ``d``."""
    name = day_name(d)
    return {
        "timestamp": epoch_seconds(d),
        "weekend": F.when(name.isin(WEEKEND_DAYS), F.lit(WEEKEND_LABEL)).otherwise(F.lit(WEEKDAY_LABEL)),
        "day_of_week": name,
        "month": F.date_format(d, "MMMM"),
        "month_day": F.dayofmonth(d),
        "year": F.year(d),
        "week_starting_monday": iso_week(d),
    }


def date_key(ts: Column, start: str | dt.date, end: str | dt.date) -> Column:
    """Key of the calendar row holding ``DATE(ts)``, or NULL outside it.

    The calendar is gap-free and keyed by day offset from its first day,
    so the lookup is arithmetic: equal to an equi-join on the date column,
    without the join."""
    d = F.to_date(ts)
    lo, hi = as_date(start), as_date(end)
    return F.when(d.between(lo, hi), F.datediff(d, lo).cast("long"))
