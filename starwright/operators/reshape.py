"""Unpivot of flag columns and pivot with explicit values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.functions.flags import is_truthy
from starwright.functions.text import title_label


def flag_labels(flag_columns: Sequence[str], prefix: str = "") -> dict[str, list[str]]:
    """Label -> flag columns that carry it, in column order.  Known when the
    plan is built, so long rows and pivot columns use the same labels."""
    out: dict[str, list[str]] = {}
    for c in flag_columns:
        out.setdefault(title_label(c, prefix), []).append(c)
    return out


def unpivot_flags(
    df: DataFrame,
    key: str | Sequence[str],
    flag_columns: Sequence[str],
    label: str,
    strip_prefix: str = "",
    unique_key: bool = False,
) -> DataFrame:
    """Wide 0/1 flag columns -> distinct (key..., label) rows for the set flags.

    Columns of one label are combined before the unpivot, which is a narrow
    Expand.  With ``unique_key`` (one row per key) no pair can occur twice and
    nothing is shuffled; otherwise the pairs are de-duplicated."""
    keys = [key] if isinstance(key, str) else list(key)
    labels = flag_labels(flag_columns, strip_prefix)
    if not labels:
        return df.select(*keys, F.lit(None).cast("string").alias(label)).limit(0)
    is_set = {lbl: reduce(lambda a, b: a | b, (F.coalesce(is_truthy(F.col(c).cast("string")), F.lit(False)) for c in cols))
              for lbl, cols in labels.items()}
    narrowed = df.select(*keys, *[c.alias(lbl) for lbl, c in is_set.items()])
    long = narrowed.unpivot(keys, [F.col(f"`{lbl}`") for lbl in labels], label, "__sw_value")
    pairs = long.where("__sw_value").select(*keys, label)
    return pairs if unique_key else pairs.dropDuplicates(keys + [label])


def pivot_fill(
    df: DataFrame,
    index: str | Sequence[str],
    column: str,
    value: str,
    values: Sequence[str],
    fill=0,
) -> DataFrame:
    """Long -> wide: one column per listed value of ``column`` holding the
    sum of ``value``; missing cells are ``fill``.  Listing the values
    avoids the extra job that discovers them."""
    idx = [index] if isinstance(index, str) else list(index)
    wide = df.groupBy(*idx).pivot(column, list(values)).agg(F.sum(value))
    return wide.fillna(fill, subset=list(values))
