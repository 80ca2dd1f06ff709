"""Dashboard marts (the data under each dashboard section).

Every mart is a lazy plan over a filtered *base* of rental rows; only the
small final results are meant to reach the driver.  Column names of the
base are parameters so the same marts run over the fact (surrogate keys)
or over source-shaped rental lines (natural ids).

Base columns used: ``rental_id``, a customer, store and film column,
``rental_date`` (DATE), ``payment_amount``, ``count_rentals``,
``rental_duration`` and the inventory item columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.functions.dates import as_date, month_start
from starwright.functions.flags import safe_div
from starwright.functions.money import cents, from_cents
from starwright.functions.text import full_name, store_label
from starwright.operators.aggregates import agg_by, bounds, sum_by, top_k, value_counts
from starwright.operators.filters import (
    between_dates, cols_with_prefix, distinct_values, drop_null, filter_by, filter_in,
)
from starwright.operators.joins import attach, attach_top
from starwright.operators.reshape import flag_labels, unpivot_flags
from starwright.plans.facts import in_keys
from starwright.schemas import CATEGORY_PREFIX, FALLBACK_DATE_RANGE


# -- M1: filter options ------------------------------------------------------

def filter_store_options(stores: DataFrame, column: str = "store_id") -> DataFrame:
    return distinct_values(stores, column)


def date_bounds(dates: DataFrame, column: str = "date") -> DataFrame:
    """(min_date, max_date) of a date column, with fallback bounds."""
    d = dates.select(F.to_date(F.col(column)).alias("__d"))
    return bounds(d, "__d", "min_date", "max_date",
                  fallback=tuple(as_date(x) for x in FALLBACK_DATE_RANGE))


# -- M2: filtered base -------------------------------------------------------

def base_from_fact(fact: DataFrame, calendar_start: str | dt.date,
                   start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
    """Fact rows with ``rental_date`` and ``payment_amount``.

    The reference left-joins the calendar on the rental date key and then
    filters on the calendar date, which makes the join inner.  The calendar
    is keyed by day offset, so the date is ``start + key``: no join.  A
    date range given here becomes a literal range on ``rental_date_key``,
    which reaches the Parquet scan, and, on the fact as it is stored, on the
    periods that name its folders, so that others are not opened."""
    origin = _py_date(calendar_start)
    key = lambda day: None if day is None else (_py_date(day) - origin).days
    df = in_keys(fact, key(start), key(end))
    return df.withColumn("rental_date", F.date_add(F.lit(origin), F.col("rental_date_key").cast("int"))) \
        .withColumnRenamed("dollar_amount", "payment_amount")


def _py_date(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def base_filtered(base: DataFrame, start: str | dt.date, end: str | dt.date,
                  stores: Iterable | None = None, store_col: str = "store_key",
                  date_col: str = "rental_date") -> DataFrame:
    """Rows with ``date_col`` in [start, end] and, if a non-empty store list
    is given, ``store_col`` in it."""
    return filter_in(between_dates(base, date_col, start, end), store_col, stores)


# -- M3: top customers -------------------------------------------------------

def top_customers(base: DataFrame, customers: DataFrame, k: int = 10, key: str = "customer_key",
                  first: str = "customer_first_name", last: str = "customer_last_name",
                  amount: str = "payment_amount") -> DataFrame:
    """Top-k customers by revenue (ties broken by key), with their names.

    Revenue per customer is aggregated first; names are attached only to
    the k winners (the customer table is semi-join reduced, not shuffled)
    when the result is computed."""
    revenue = sum_by(base, key, amount, "total_revenue")
    top = top_k(revenue, k, [F.col("total_revenue").desc(), F.col(key).asc()])
    names = customers.select(key, first, last)
    return attach_top(top, names, key).select(
        key, full_name(F.col(first), F.col(last)).alias("customer_name"), "total_revenue")


# -- M4: monthly revenue by category ----------------------------------------

def category_map(films: DataFrame, key: str = "film_key", label: str = "film_category",
                 prefix: str = CATEGORY_PREFIX, unique_key: bool = False) -> DataFrame:
    """(film, category) pairs recovered from the one-hot flag columns found
    by prefix (in any case): unpivot, keep set flags, strip prefix, title-case.
    ``unique_key``: ``films`` has one row per key, so no pair can repeat."""
    flag_cols = cols_with_prefix(films, prefix)
    return unpivot_flags(films, key, flag_cols, label, strip_prefix=prefix, unique_key=unique_key)


def category_labels(films: DataFrame, prefix: str = CATEGORY_PREFIX) -> list[str]:
    """The labels :func:`category_map` can give, in column order."""
    return list(flag_labels(cols_with_prefix(films, prefix), prefix))


def revenue_by_month_category(base: DataFrame, cat_map: DataFrame, film: str = "film_key",
                              amount: str = "payment_amount", date_col: str = "rental_date",
                              label: str = "film_category", ordered: bool = True) -> DataFrame:
    """(rental_month, film_category, revenue), by month and falling revenue
    unless ``ordered`` is off (a pivot needs no order).

    A film in several categories counts its whole revenue in each.  Revenue
    is pre-aggregated per (film, month) in exact cents before the
    many-to-many join, so the join sees one row per film-month instead of
    one per rental; groups whose amounts are all NULL drop out, as rows
    with a NULL amount do."""
    per_film_month = (
        drop_null(base, [date_col])
        .groupBy(F.col(film).alias("__film"), month_start(F.col(date_col)).alias("rental_month"))
        .agg(F.sum(cents(amount)).alias("__cents"))
        .where(F.col("__cents").isNotNull())
    )
    m = drop_null(cat_map.select(F.col(film).alias("__film"), label), [label])
    long = (
        per_film_month.join(m, "__film", "inner")
        .groupBy("rental_month", label).agg(from_cents(F.sum("__cents")).alias("revenue"))
    )
    return long.orderBy(F.col("rental_month").asc(), F.col("revenue").desc()) if ordered else long


def revenue_pivot(long: DataFrame, labels: Sequence[str], label: str = "film_category") -> DataFrame:
    """Month x category revenue, one column per listed label, missing 0.0.
    Cells are re-summed in cents, so the wide sums equal the long ones."""
    wide = (
        long.withColumn("__cents", cents("revenue"))
        .groupBy("rental_month").pivot(label, list(labels)).agg(F.sum("__cents"))
    )
    # One row per month: few enough to be sorted in one task, with no shuffle.
    return wide.select(
        "rental_month", *[F.coalesce(from_cents(F.col(f"`{lbl}`")), F.lit(0.0)).alias(lbl) for lbl in labels]
    ).coalesce(1).sortWithinPartitions("rental_month")


# -- M5: store performance ---------------------------------------------------

def store_performance(base: DataFrame, stores: DataFrame, key: str = "store_key", store_id: str = "store_id",
                      first: str = "store_manager_first_name", last: str = "store_manager_last_name",
                      amount: str = "payment_amount") -> DataFrame:
    """Per store: revenue, rentals, transactions, average ticket and label."""
    # A store whose amounts (or counts) are all NULL has sums of 0.
    perf = agg_by(base, key, {
        "revenue": from_cents(F.coalesce(F.sum(cents(amount)), F.lit(0))),
        "rentals": F.coalesce(F.sum("count_rentals"), F.lit(0)).cast("long"),
        "txns": F.count("rental_id"),
    }).withColumn("avg_ticket", safe_div(F.col("revenue"), F.col("txns")))
    cols = [key] + ([store_id] if store_id != key else []) + [first, last]
    lookup = stores.select(*cols).dropDuplicates([key])
    labelled = attach(perf, lookup, key)  # one row per store on each side: the planner picks
    return labelled.select(
        *([key] if store_id == key else [key, store_id]),
        store_label(F.col(store_id), F.col(first), F.col(last)).alias("store_label"),
        "revenue", "rentals", "txns", "avg_ticket",
    ).orderBy(F.col("revenue").desc())


def store_kpis(perf: DataFrame) -> DataFrame:
    """Totals over stores: revenue, rentals, the unweighted mean of store
    average tickets (as the reference reports it) and the overall average
    ticket (total revenue / total transactions)."""
    return perf.agg(
        from_cents(F.sum(cents("revenue"))).alias("total_revenue"),
        F.sum("rentals").cast("long").alias("total_rentals"),
        F.round(F.avg("avg_ticket"), 6).alias("avg_ticket_unweighted"),
        safe_div(from_cents(F.sum(cents("revenue"))), F.sum("txns")).alias("avg_ticket_overall"),
    )


# -- M6: inventory utilisation ----------------------------------------------

def inventory_utilization(base: DataFrame, item: Sequence[str] = ("inventory_id",)) -> DataFrame:
    """Rentals per inventory item."""
    items = list(item)
    out = base
    for c in items:
        out = out.where(F.col(c).isNotNull())
    return out.groupBy(*items).agg(F.coalesce(F.sum("count_rentals"), F.lit(0)).cast("long").alias("rentals"))


def inventory_stats(util: DataFrame) -> DataFrame:
    """Number of items and mean rentals per item."""
    return util.agg(F.count(F.lit(1)).alias("items"),
                    (F.sum("rentals").cast("double") / F.count(F.lit(1))).alias("avg_rentals"))


def inventory_histogram(util: DataFrame) -> DataFrame:
    """How many items have each rental count."""
    return value_counts(util, "rentals", "items")


def inventory_top(util: DataFrame, k: int = 25, item: Sequence[str] = ("inventory_id",)) -> DataFrame:
    return top_k(util, k, [F.col("rentals").desc(), *[F.col(c).asc() for c in item]])


# -- M7: average rental duration by category --------------------------------

def avg_duration_by_category(base: DataFrame, cat_map: DataFrame, film: str = "film_key",
                             duration: str = "rental_duration", label: str = "film_category",
                             durations: DataFrame | None = None) -> DataFrame:
    """Mean rental duration per category over base rows.

    Pre-aggregated per film (sum and count of non-NULL durations) before
    the many-to-many join; integer sums keep the mean exact.  When the
    duration is a film attribute held elsewhere, pass ``durations`` (film,
    duration): base rows are then counted per film first and the film
    table meets one row per film, not one per rental."""
    if durations is None:
        per_film = (
            drop_null(base, [duration])
            .groupBy(F.col(film).alias("__film"))
            .agg(F.sum(F.col(duration).cast("long")).alias("__s"), F.count(F.lit(1)).alias("__n"))
        )
    else:
        counts = base.groupBy(F.col(film).alias("__film")).agg(F.count(F.lit(1)).alias("__rows"))
        d = drop_null(durations.select(F.col(film).alias("__film"), F.col(duration).cast("long").alias("__d")),
                      ["__d"])
        per_film = counts.join(d, "__film", "inner").select(
            "__film", (F.col("__d") * F.col("__rows")).alias("__s"), F.col("__rows").alias("__n"))
    m = drop_null(cat_map.select(F.col(film).alias("__film"), label), [label])
    return (
        per_film.join(m, "__film", "inner")
        .groupBy(label).agg((F.sum("__s").cast("double") / F.sum("__n")).alias("avg_rental_duration"))
        .orderBy(F.col("avg_rental_duration").desc())
    )


# -- the dashboard: sections -> marts ---------------------------------------

# FIXED VALUES -- the dashboard's section names and its default selection.
SECTIONS = [
    "Top 10 customers by revenue",
    "Monthly revenue trend by category",
    "Store performance",
    "Inventory utilization",
    "Avg rental duration by category",
]
DEFAULT_SECTIONS = SECTIONS[:3]


def dashboard(
    fact: DataFrame,
    customers: DataFrame,
    stores: DataFrame,
    films: DataFrame,
    calendar_start: str | dt.date,
    start: str | dt.date,
    end: str | dt.date,
    store_ids: Iterable | None = None,
    sections: Sequence[str] = DEFAULT_SECTIONS,
    item: Sequence[str] = ("inventory_id",),
    cache_base: bool = False,
) -> dict[str, DataFrame]:
    """The data under each selected dashboard section, as lazy plans over
    one filtered base read from the written fact and dimensions.

    The store picker offers store ids; the fact holds keys, so it is semi-joined
    to the stores picked: ids that no store has select no rows, while an empty
    selection (or None) selects every store.  Each section re-reads the fact
    with the date filter pushed to the scan; ``cache_base`` keeps the filtered
    base instead, worth it only when it is small (a short range read by several
    sections)."""
    wanted = [s for s in sections if s in SECTIONS]
    base = base_filtered(base_from_fact(fact, calendar_start, start, end), start, end)
    if store_ids:
        base = filter_by(base, "store_key", filter_in(stores, "store_id", store_ids))
    if cache_base and len(wanted) > 1:
        base = base.cache()
    out: dict[str, DataFrame] = {}
    # The film key is unique in the film dimension.
    cat_map = category_map(films, unique_key=True) if any("category" in s for s in wanted) else None
    for s in wanted:
        if s == SECTIONS[0]:
            out[s] = top_customers(base, customers, 10)
        elif s == SECTIONS[1]:
            out[s] = revenue_by_month_category(base, cat_map)
            long = revenue_by_month_category(base, cat_map, ordered=False)
            out[s + " (pivot)"] = revenue_pivot(long, category_labels(films))
        elif s == SECTIONS[2]:
            perf = store_performance(base, stores)
            out[s] = perf
            out[s + " (totals)"] = store_kpis(perf)
        elif s == SECTIONS[3]:
            util = inventory_utilization(base, item)
            out[s] = util
            out[s + " (stats)"] = inventory_stats(util)
            out[s + " (histogram)"] = inventory_histogram(util)
            out[s + " (top 25)"] = inventory_top(util, 25, item)
        elif s == SECTIONS[4]:
            out[s] = avg_duration_by_category(base, cat_map)
    return out
