"""Exact money arithmetic.

Amounts are stored as doubles with two decimals.  Sums are taken over
integer cents so that the result does not depend on the order in which
partitions are combined (and equals the same sum computed by any other
engine).  A long holds 9.2e18 cents, i.e. 9.2e16 currency units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column | str) -> Column:
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.round(c * F.lit(100)).cast("long")


def from_cents(total_cents: Column | str) -> Column:
    c = F.col(total_cents) if isinstance(total_cents, str) else total_cents
    return c.cast("double") / F.lit(100.0)


def money_sum(amount: Column | str) -> Column:
    """Exact sum of an amount column; NULL when every input is NULL."""
    return from_cents(F.sum(cents(amount)))
