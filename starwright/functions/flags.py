"""Flag and predicate expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from starwright.schemas import TRUTHY_TEXT, category_column


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag_not_null(c: Column | str) -> Column:
    """1 when the value is present, else 0 (e.g. returned or not)."""
    return F.when(_c(c).isNotNull(), F.lit(1)).otherwise(F.lit(0))


def contains_flags(c: Column | str, flags: Mapping[str, str]) -> dict[str, Column]:
    """``{flag_name: 1 if text contains substring else 0}``; NULL text -> 0.

    Flags are bound by name, so their order can never be swapped."""
    text = _c(c)
    return {
        name: F.when(text.contains(F.lit(sub)), F.lit(1)).otherwise(F.lit(0))
        for name, sub in flags.items()
    }


def one_hot(c: Column | str, labels: Iterable[str], column_name=category_column) -> dict[str, Column]:
    """``{column_name(label): 1 if value == label else 0}`` for each label."""
    value = _c(c)
    return {
        column_name(label): F.when(value == F.lit(label), F.lit(1)).otherwise(F.lit(0))
        for label in labels
    }


def is_truthy(c: Column | str) -> Column:
    """True when the value's text form is one of the truthy tokens (an
    integer flag 1, a boolean true, or the text 'True' / 'TRUE' / 'true')."""
    return _c(c).cast("string").isin(TRUTHY_TEXT)


def null_if_tokens(c: Column | str, tokens: Iterable[str]) -> Column:
    """NULL when the (string) value is one of ``tokens``; the CSV reader's
    ``nullValue`` option accepts a single token only."""
    value = _c(c)
    return F.when(value.isin(list(tokens)), F.lit(None).cast("string")).otherwise(value)


def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den))
