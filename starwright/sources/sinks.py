"""Writers: create-or-replace, append by name, append by load, export."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.sources.publish import Folder, publish


def conform(df: DataFrame, schema: T.StructType, cast: bool = True) -> DataFrame:
    """Select the schema's columns by name, in its order (missing -> NULL).

    ``cast=True`` casts to the declared types (ANSI: a value that does not
    fit raises rather than turning NULL); ``cast=False`` keeps the values
    as they are, e.g. for text export, where the loader's type check then
    rejects what does not fit."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)
        cols.append((c.cast(f.dataType) if cast else c).alias(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None,
                partition_by: Sequence[str] = ()) -> None:
    """Create or replace a Parquet table, optionally conformed to ``schema``.
    The rows are written beside the table, which is then switched: a write that
    fails leaves the table as it was."""
    publish(conform(df, schema) if schema is not None else df, path, partition_by)


def append_table(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append to a table binding columns by name, never by position.  A retry
    appends again; :func:`append_load` does not."""
    df.select(*columns).write.mode("append").parquet(path)


LOAD_COLUMN = "load_id"


def append_load(df: DataFrame, path: str, columns: Sequence[str], load_id: str | int) -> None:
    """Append the rows of one load, columns bound by name, such that the load
    counts once however often it is run.

    A load is a partition of the table (column ``load_id``).  It is written
    beside the table and switched in, so a load that fails leaves none of its
    rows, and a load run again replaces its own rows only, also when it then has
    fewer or no rows.  Loads of different ids may run at the same time.  Columns
    must have the names and types of the loads that are there."""
    if not re.match(r"[A-Za-z0-9][A-Za-z0-9.-]*\Z", str(load_id)):
        raise ValueError(f"load id {load_id!r} is not of letters, digits, dots and dashes")
    rows = df.select(*columns)
    if LOAD_COLUMN in rows.columns:
        raise ValueError(f"{LOAD_COLUMN} is the column that names loads")
    others = [c for c in Folder(df.sparkSession, path).children() if c.startswith(f"{LOAD_COLUMN}=")]
    if others:
        there = {f.name: f.dataType for f in df.sparkSession.read.parquet(f"{path}/{others[0]}").schema.fields}
        own = {f.name: f.dataType for f in rows.schema.fields}
        if there != own:
            raise ValueError(f"columns of the load differ from those of {path}: {sorted(map(str, there.items() ^ own.items()))}")
        rows = rows.select(*there)
    publish(rows, f"{path}/{LOAD_COLUMN}={load_id}")


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all loads with ``load_id`` as text, whatever it looks like."""
    for name in Folder(spark, path).children():
        if name.startswith(f"{LOAD_COLUMN}="):
            fields = spark.read.parquet(f"{path}/{name}").schema.fields
            schema = T.StructType([*fields, T.StructField(LOAD_COLUMN, T.StringType())])
            return spark.read.schema(schema).parquet(path)
    raise FileNotFoundError(f"no loads in {path}")


def export_tables(tables: Mapping[str, DataFrame], root: str, header: bool = True,
                  rows_per_file: int = 1_000_000) -> dict[str, str]:
    """Write each table as CSV under ``{root}/{name}`` with every field
    quoted; returns the paths written.  Files hold a bounded number of rows:
    a quoted line break keeps a file from being split when it is read."""
    paths = {}
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        (df.write.mode("overwrite").option("header", str(header).lower())
         .option("quoteAll", "true").option("escape", '"').option("maxRecordsPerFile", rows_per_file)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
         .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd")
         .csv(path))
        paths[name] = path
    return paths
