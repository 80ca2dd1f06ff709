"""The rental fact: star lookups, role-playing dates and measures."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.functions.dates import date_key
from starwright.functions.flags import flag_not_null
from starwright.operators.defaults import apply_defaults
from starwright.operators.joins import left_join_detail, lookup_key
from starwright.schemas import FACT_DEFAULTS

# The written fact is partitioned by stretches of so many days.
PERIOD, PERIOD_DAYS = "rental_period", 30


def by_period(fact: DataFrame) -> DataFrame:
    """The fact as it is written: with the period of its rental date, rows of a
    period together and sorted by date.  Ranges go on to the rental id, so a day
    that holds much of the fact is several tasks' work, each with few files."""
    order = [PERIOD, "rental_date_key", "rental_id"]
    return fact.withColumn(PERIOD, F.floor(F.col("rental_date_key") / PERIOD_DAYS).cast("int")).repartitionByRange(
        *order).sortWithinPartitions(*order)


def in_keys(fact: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows of a range of rental date keys, both ends included; of a fact with
    periods only the folders of the range are read."""
    for value, at_least in ((low, True), (high, False)):
        if value is None:
            continue
        for column, bound in (("rental_date_key", value), (PERIOD, value // PERIOD_DAYS)):
            if column in fact.columns:
                fact = fact.where(F.col(column) >= bound if at_least else F.col(column) <= bound)
    return fact.drop(PERIOD)


def rental_lines(rental: DataFrame, inventory: DataFrame, payment: DataFrame) -> DataFrame:
    """Rental joined to its inventory item and left-joined to payments.

    One row per rental x payment: a rental without payment is kept with a
    NULL amount, a rental with several payments repeats."""
    inv = inventory.select("inventory_id", "film_id", "store_id")
    pay = payment.select("rental_id", "amount")
    lines = left_join_detail(rental.join(inv, "inventory_id", "inner"), pay, "rental_id")
    known = {"rental_id", "customer_id", "staff_id", "rental_date", "return_date", "inventory_id", "last_update"}
    extra = [c for c in rental.columns if c not in known]  # e.g. a customer key resolved upstream
    return lines.select(
        "rental_id", "customer_id", "staff_id", "film_id", "store_id", "rental_date", "return_date",
        "amount", "inventory_id", F.col("last_update").alias("rental_last_update"), *extra)


def payment_per_rental(payment: DataFrame) -> DataFrame:
    """Payments pre-aggregated to one row per rental (exact cents sum), for
    a fact whose grain must stay one row per rental."""
    from starwright.functions.money import money_sum
    return payment.groupBy("rental_id").agg(money_sum("amount").alias("amount"))


def date_keys(lines: DataFrame, calendar: tuple[dt.date, dt.date],
              rental_col: str = "rental_date", return_col: str = "return_date") -> DataFrame:
    """Role-playing calendar lookups: the rental date must be inside the
    calendar (rows outside are dropped, as by an inner join); the return
    date key is NULL when not returned or outside the calendar (left
    join).  ``count_returns`` is 1 whenever a return date exists."""
    start, end = calendar
    rk = date_key(F.col(rental_col), start, end)
    return (
        lines.withColumn("rental_date_key", rk).where(F.col("rental_date_key").isNotNull())
        .withColumn("return_date_key", date_key(F.col(return_col), start, end))
        .withColumn("count_returns", flag_not_null(return_col))
    )


def date_key_join(lines: DataFrame, dim_date: DataFrame, ts_col: str, key_alias: str, how: str = "inner") -> DataFrame:
    """Role-playing calendar lookup by join, for a calendar table whose keys
    are not day offsets (e.g. one loaded from files): ``DATE(ts)`` equals
    the calendar date; ``inner`` drops rows outside it, ``left`` keeps them
    with a NULL key.  The calendar holds one row per day of a fixed range,
    so its size is bounded by that range, not by the data: broadcast."""
    cal = dim_date.select(F.col("date").alias(f"__{key_alias}_date"), F.col("date_key").alias(key_alias))
    cond = F.to_date(F.col(ts_col)) == F.col(f"__{key_alias}_date")
    return lines.join(F.broadcast(cal), cond, how).drop(f"__{key_alias}_date")


def staff_with_store(staff: DataFrame, stores: DataFrame) -> DataFrame:
    """(staff_id, staff_key, store_key): staff joined to their store, two
    dimensions, before either meets the lines."""
    own = staff.select("staff_id", "staff_key", F.col("staff_store_id").alias("store_id"))
    return own.join(stores.select("store_id", "store_key"), "store_id", "inner").drop("store_id")


def build_fact(
    lines: DataFrame,
    customers: DataFrame,
    staff: DataFrame,
    films: DataFrame,
    stores: DataFrame,
    calendar: tuple[dt.date, dt.date],
    carry: Sequence[str] = (),
    store_from_staff: bool = False,
) -> DataFrame:
    """Fact rows: six surrogate keys, measures and any ``carry`` columns.

    Dimension lookups are equi-joins on natural ids (the planner picks
    broadcast or shuffle from sizes; AQE splits skewed keys).  A key already
    present in ``lines`` (resolved upstream on a smaller table, e.g. the
    customer key on orders before they meet their lines) is kept as is.
    ``store_from_staff``: the store is the staff member's, so staff and store
    are joined first and the lines meet them once.
    Date keys are arithmetic on the gap-free calendar, so the two calendar
    joins cost nothing.  ``rental_duration`` is the film's allowed days,
    taken from the film dimension."""
    df = date_keys(lines, calendar)
    if "customer_key" not in df.columns:
        df = lookup_key(df, customers, "customer_id", "customer_id", "customer_key")
    if "staff_key" not in df.columns:
        if store_from_staff:
            df = lookup_key(df.drop("store_id"), staff_with_store(staff, stores), "staff_id", "staff_id",
                            ["staff_key", "store_key"])
        else:
            df = lookup_key(df, staff, "staff_id", "staff_id", "staff_key")
    if "film_key" not in df.columns:
        df = lookup_key(df, films, "film_id", "film_id", ["film_key", "film_rental_duration"])
    if "store_key" not in df.columns:
        df = lookup_key(df, stores, "store_id", "store_id", "store_key")
    out = df.select(
        F.col("rental_id").cast("long"), "rental_last_update", "customer_key", "staff_key", "film_key",
        "store_key", "rental_date_key", "return_date_key", F.lit(1).alias("count_rentals"),
        "count_returns", F.col("film_rental_duration").cast("int").alias("rental_duration"),
        F.col("amount").cast("double").alias("dollar_amount"),
        # Days actually rented (NULL until returned); rental_duration is the
        # film's allowed days, kept as the reference defines it.
        F.datediff(F.to_date("return_date"), F.to_date("rental_date")).alias("actual_days"), *carry)
    return apply_defaults(out, {**FACT_DEFAULTS, "rental_last_update": "CURRENT_TIMESTAMP"})
