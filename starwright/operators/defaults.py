"""Declared column defaults and NULL fills."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULL by the declared default; add the column with its default
    when it is missing.  A default of ``"CURRENT_TIMESTAMP"`` uses the
    query's (single, consistent) current time, zone-less for a
    TIMESTAMP_NTZ column."""
    cols = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    for name, default in defaults.items():
        if default == "CURRENT_TIMESTAMP":
            ntz = name not in types or types[name].typeName() == "timestamp_ntz"
            lit = F.localtimestamp() if ntz else F.current_timestamp()
        else:
            lit = F.lit(default)
        cols[name] = F.coalesce(F.col(name), lit) if name in df.columns else lit
    return df.withColumns(cols)


def fill(df: DataFrame, text: str = "", number: float | int = 0) -> DataFrame:
    """NULL text -> ``text``, NULL numbers -> ``number``."""
    string_cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    numeric_cols = [f.name for f in df.schema.fields
                    if f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float")
                    or f.dataType.typeName().startswith("decimal")]
    out = df.fillna(text, subset=string_cols) if string_cols else df
    return out.fillna(number, subset=numeric_cols) if numeric_cols else out
