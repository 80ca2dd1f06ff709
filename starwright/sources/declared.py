"""Catalogue tables whose declared lengths, types and defaults Spark itself
enforces, instead of casts and checks around the write.  (NOT NULL is kept by the
insert, as Spark does not enforce it for tables of files.)

``VARCHAR(n)`` stands for CHAR(n) too, which would pad values with blanks.  Money
keeps its declared DECIMAL(p, s).  A value that is too long or does not fit, or a
NULL where none is allowed, fails the insert; a column that an insert leaves out
gets its default.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.schemas import DATE_DEFAULTS, FACT_DEFAULTS, WAREHOUSE, TableSpec

# Declared defaults; a table's first timestamp is when its row was last updated.
DEFAULTS: dict[str, dict[str, object]] = {"dim_date": DATE_DEFAULTS, "fact_rental": FACT_DEFAULTS}


def _literal(value: object) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def column_sql(spec: TableSpec, field: T.StructField, default: object = None) -> str:
    """A column's declaration."""
    kind = field.dataType.simpleString()
    if field.name in spec.lengths:
        kind = f"varchar({spec.lengths[field.name]})"
    elif field.name in spec.decimals:
        kind = "decimal({}, {})".format(*spec.decimals[field.name])
    if default is None and isinstance(field.dataType, T.TimestampNTZType) and field.name.endswith("last_update"):
        said = " DEFAULT localtimestamp()"
    else:
        said = f" DEFAULT {_literal(default)}" if default is not None else ""
    return f"`{field.name}` {kind}{'' if field.nullable else ' NOT NULL'}{said}"


def create_table(spark: SparkSession, spec: TableSpec, name: str | None = None,
                 defaults: Mapping[str, object] | None = None) -> str:
    """Create the declared table in the catalogue (an existing one stays);
    returns its name."""
    name = name or spec.name
    own = DEFAULTS.get(spec.name, {}) if defaults is None else defaults
    columns = ", ".join(column_sql(spec, f, own.get(f.name)) for f in spec.schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    return name


def create_warehouse(spark: SparkSession, database: str) -> list[str]:
    """All declared tables of the warehouse in one database."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    return [create_table(spark, spec, f"{database}.{name}") for name, spec in sorted(WAREHOUSE.items())]


def insert_rows(df: DataFrame, table: str, columns: Sequence[str] | None = None, spec: TableSpec | None = None) -> None:
    """Insert rows, columns bound by name; those left out get their default.  An
    insert that fails, for a NULL in a NOT NULL column, a value that is too long
    or of another type, or an error in ``df``, leaves none of its rows.  ``spec``
    is the declared table of that name by default."""
    spark, columns = df.sparkSession, list(columns or df.columns)
    spec = spec or WAREHOUSE[table.split(".")[-1]]
    declared = spark.table(table).columns
    if unknown := [c for c in columns if c not in declared]:
        raise ValueError(f"{table} has no columns {unknown}")
    has_default = {f.name for f in spark.table(table).schema.fields if "CURRENT_DEFAULT" in (f.metadata or {})}
    if missing := [c for c in spec.not_null if c not in columns and c not in has_default]:
        raise ValueError(f"{table} needs columns {missing}")
    kept = [F.coalesce(c, F.raise_error(F.lit(f"NULL in {table}.{c}"))).alias(c) if c in spec.not_null else c for c in columns]
    view = f"rows_{uuid.uuid4().hex}"
    df.select(*kept).createOrReplaceTempView(view)
    names = ", ".join(f"`{c}`" for c in columns)
    try:
        spark.sql(f"INSERT INTO {table} ({names}) SELECT {names} FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
