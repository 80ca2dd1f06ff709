"""Grouped aggregates, roll-ups, top-k and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.functions.money import cents, from_cents


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sum_by(df: DataFrame, key: str | Sequence[str], value: str, alias: str, money: bool = True) -> DataFrame:
    """Sum per key with NULL keys dropped; a group whose values are all NULL
    sums to 0 (not NULL).  Partial aggregation runs before the shuffle, so a
    hot key is combined map-side."""
    keys = _keys(key)
    src = df
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    if money:
        agg = F.coalesce(from_cents(F.sum(cents(value))), F.lit(0.0))
    else:
        agg = F.coalesce(F.sum(value), F.lit(0))
    return src.groupBy(*keys).agg(agg.alias(alias))


def agg_by(df: DataFrame, key: str | Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Several named aggregates per key, NULL keys dropped."""
    keys = _keys(key)
    src = df
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    return src.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def bounds(df: DataFrame, column: str, lo_alias: str = "min_value", hi_alias: str = "max_value",
           fallback: tuple | None = None) -> DataFrame:
    """Global min / max of a column (one row); optional fallback values
    when the column has no non-NULL value."""
    lo, hi = F.min(column), F.max(column)
    if fallback is not None:
        lo, hi = F.coalesce(lo, F.lit(fallback[0])), F.coalesce(hi, F.lit(fallback[1]))
    return df.where(F.col(column).isNotNull()).agg(lo.alias(lo_alias), hi.alias(hi_alias))


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """First k rows in ``order`` (planned as TakeOrderedAndProject: each
    partition keeps its own k, then one small merge).  Include a unique
    tie-break in ``order`` for a deterministic cut."""
    return df.orderBy(*order).limit(k)


def value_counts(df: DataFrame, column: str, alias: str = "count") -> DataFrame:
    """Frequency of each value of ``column``, ordered by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(alias)).orderBy(column)


def row_count(df: DataFrame, name: str) -> DataFrame:
    """One row: (table_name, row_count)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), F.col("row_count").cast("long")
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table, ordered by table name."""
    frames = [row_count(df, name) for name, df in sorted(tables.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy("table_name")


def footer_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """:func:`row_counts` of Parquet tables from their footers: the count is
    pushed into the scan, which reads no column.  (The source that can do so is
    chosen by a setting, so the plan is made in a session of its own; it shares
    everything else with ``spark``.)"""
    own = spark.newSession()
    v1 = own.conf.get("spark.sql.sources.useV1SourceList").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in v1 if x != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    counts = row_counts({name: own.read.parquet(path) for name, path in paths.items()})
    # A table without any row group has no footer to count: it counts 0.
    none = own.createDataFrame([(name, 0) for name in paths], "table_name string, row_count long")
    return counts.unionByName(none).groupBy("table_name").agg(F.sum("row_count").alias("row_count")).orderBy("table_name")
