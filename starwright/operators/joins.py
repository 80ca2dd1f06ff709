"""Join helpers: key lookups, late attach, skew-safe detail joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_key(
    df: DataFrame,
    dim: DataFrame,
    left_on: str | Sequence[str],
    right_on: str | Sequence[str],
    take: str | Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Resolve a natural id to a dimension's surrogate key (and/or other
    columns).  The dimension is projected to the join and taken columns
    first; the physical strategy (broadcast or shuffle) is left to the
    planner's size estimate and AQE."""
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = [right_on] if isinstance(right_on, str) else list(right_on)
    tk = [take] if isinstance(take, str) else list(take)
    renamed = {r: f"__sw_r_{i}" for i, r in enumerate(rk)}
    right = dim.select(*[F.col(r).alias(renamed[r]) for r in rk], *[c for c in tk if c not in rk])
    cond = [df[lcol] == right[renamed[rcol]] for lcol, rcol in zip(lk, rk)]
    return df.join(right, cond, how).drop(*renamed.values())


def attach(small: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a small result to a lookup table; the planner picks the strategy."""
    return small.join(lookup, [on] if isinstance(on, str) else list(on), how)


def attach_top(top: DataFrame, lookup: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join of a top-k result to a lookup table, without moving the table.

    The k keys of the result are broadcast to reduce the lookup by a semi
    join, and the reduced lookup (rows of at most k keys) is broadcast back.
    Both broadcasts are bounded by k; nothing is computed when the plan is
    built."""
    keys = [on] if isinstance(on, str) else list(on)
    reduced = lookup.join(F.broadcast(top.select(*keys)), keys, "left_semi")
    return top.join(F.broadcast(reduced), keys, "left")


def left_join_detail(df: DataFrame, detail: DataFrame, on: str | Sequence[str], skew_safe: bool = True) -> DataFrame:
    """Left join to detail rows: unmatched rows kept once with NULL detail,
    rows with several details repeated once per detail (fan-out).

    ``skew_safe`` (default) writes it as matched rows (an inner join, whose
    skewed keys AQE can split on either side) plus unmatched rows (an anti
    join against the detail's distinct keys, de-duplicated map-side).  A
    plain left outer join can only be split on its left side, so a detail
    key holding a large share of the rows would land in one task."""
    keys = [on] if isinstance(on, str) else list(on)
    if not skew_safe:
        return df.join(detail, keys, "left")
    matched = df.join(detail, keys, "inner")
    unmatched = df.join(detail.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
