"""Move the warehouse between stores through delimited files: export every
table to quoted CSV, load the files back into the declared schemas (by
position, with rejects), and reconcile the exported rows with those written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.operators.aggregates import row_counts
from starwright.operators.quality import compare_content
from starwright.plans.warehouse import Warehouse
from starwright.schemas import WAREHOUSE
from starwright.sources.csv_load import CsvFormat, clean_fields, load_table, profile
from starwright.sources.sinks import conform, export_tables


def export_warehouse(wh: Warehouse, root: str, names: Sequence[str] | None = None) -> dict[str, str]:
    """Write each warehouse table as CSV under ``{root}/{name}``, fields in
    the declared column order (the order a positional load expects).
    Values are written as they are: one that does not fit its declared
    type is rejected, with its reason, when the files are loaded back."""
    chosen = [n for n in (names or sorted(wh.paths)) if n in WAREHOUSE]
    return export_tables({n: conform(wh.read(n), WAREHOUSE[n].schema, cast=False) for n in chosen}, root)


def exported_rows(wh: Warehouse, names: Sequence[str]) -> dict[str, DataFrame]:
    """Rows of the exported tables, counted at their source."""
    return {n: row_counts({n: wh.read(n)}).selectExpr("row_count as rows_read") for n in names}


def load_exported(
    spark: SparkSession, paths: Mapping[str, str], root: str, fmt: CsvFormat | str = "utf8",
    exported: Mapping[str, DataFrame] | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Load exported files into ``{root}/{name}`` (fields by position, as
    declared; rejects into ``{root}/rejects/{name}``) and reconcile each table:
    rows exported (``exported``; without it the records of the files) against
    rows written and records rejected.  Returns the tables and the report."""
    reports = [load_table(spark, p, WAREHOUSE[n].schema, f"{root}/{n}", f"{root}/rejects/{n}", fmt, table_name=n,
                          source=(exported or {}).get(n)) for n, p in sorted(paths.items())]
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return {n: spark.read.parquet(f"{root}/{n}") for n in paths}, report.orderBy("table_name")


def compare_exported(
    wh: Warehouse, tables: Mapping[str, DataFrame], fmt: CsvFormat | str = "utf8",
) -> DataFrame:
    """Content of the loaded tables against that of the warehouse they were
    exported from, one row each (:func:`compare_content`).  Texts count as the
    profile reads them (trimmed, NULL tokens) and times to the second, which is
    what the files hold."""
    if isinstance(fmt, str):
        fmt = profile(fmt)
    report = None
    for name, loaded in sorted(tables.items()):
        source = conform(wh.read(name), WAREHOUSE[name].schema)
        texts = T.StructType([f for f in source.schema.fields if isinstance(f.dataType, T.StringType)])
        times = [f.name for f in source.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        source = clean_fields(source, texts, fmt) if texts.fields else source
        source = source.withColumns({c: F.date_trunc("second", c) for c in times}) if times else source
        shown = [F.col(c).cast("timestamp_ntz").alias(c) if c in times else c for c in source.columns]
        row = compare_content(name, source.select(*shown), loaded.select(*shown))
        report = row if report is None else report.unionByName(row)
    return report.orderBy("table_name")
