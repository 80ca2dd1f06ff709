"""Row filters and projections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.functions.dates import as_date


def project(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename projection ``{source: target}`` (only listed columns kept)."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def between_dates(df: DataFrame, column: str, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """Inclusive date range with typed literals (pushed to the scan)."""
    return df.where(F.col(column).between(as_date(start), as_date(end)))


def filter_in(df: DataFrame, column: str, values: Iterable | None) -> DataFrame:
    """Keep rows whose ``column`` is in a selection of ``values``; an empty
    selection (or None) means no selection: no filter.  To filter by the
    rows of a table, which may well be none, use :func:`filter_by`."""
    vals = list(values or [])
    return df.where(F.col(column).isin(vals)) if vals else df


def filter_by(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Keep rows whose ``column`` occurs in the column of that name of
    ``keys``; no keys, no rows."""
    return df.join(keys.select(column), column, "left_semi")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-NULL values of one column."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def drop_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with NULL in any of ``columns``."""
    return df.dropna(how="any", subset=list(columns))


def cols_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Column names starting with ``prefix`` (case-insensitive), in order."""
    p = prefix.lower()
    return [c for c in df.columns if c.lower().startswith(p)]
