"""Dashboard marts on literal rows, including the NULL edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from starwright.plans import marts

D = dt.date


def _base(spark):
    return spark.createDataFrame(
        [(1, 7, 1, 10, D(2005, 5, 1), None, 1, 3, 100),
         (2, 7, 1, 10, D(2005, 5, 2), None, 1, 3, 100),
         (3, 8, 1, 11, D(2005, 5, 3), 5.0, 1, 5, 101),
         (4, None, 2, 11, D(2005, 6, 3), 5.0, 1, 5, 102),
         (5, 9, 2, 12, D(2005, 6, 9), 2.5, 1, None, 102),
         (6, 9, 3, 12, D(2005, 7, 1), 1.25, 1, 4, 103)],
        "rental_id int, customer_key int, store_key int, film_key int, rental_date date, "
        "payment_amount double, count_rentals int, rental_duration int, inventory_id int")


def test_top_customers_null_rules(spark):
    customers = spark.createDataFrame([(7, "Ann", None), (8, None, "Lee"), (9, "Bo", "Ek")],
                                      "customer_key int, customer_first_name string, customer_last_name string")
    rows = {r.customer_key: (r.customer_name, r.total_revenue)
            for r in marts.top_customers(_base(spark), customers, 10).collect()}
    # all-NULL group sums to 0.0, NULL key dropped, NULL name parts blank
    assert rows == {8: ("Lee", 5.0), 9: ("Bo Ek", 3.75), 7: ("Ann", 0.0)}


def test_top_k_cut_and_tie_break(spark):
    customers = spark.createDataFrame([(7, "A", "B")], "customer_key int, customer_first_name string, customer_last_name string")
    top = marts.top_customers(_base(spark), customers, 2).collect()
    assert [r.customer_key for r in top] == [8, 9]
    assert top[1].customer_name == ""  # unmatched lookup keeps the row


def test_base_filter_empty_store_list_means_all(spark):
    b = _base(spark)
    assert marts.base_filtered(b, "2005-05-01", "2005-06-30", []).count() == 5
    assert marts.base_filtered(b, "2005-05-01", "2005-06-30", [2]).count() == 2


def test_revenue_month_category_and_pivot(spark):
    b = _base(spark)
    cat_map = spark.createDataFrame([(10, "Action"), (11, "Action"), (11, "Comedy"), (12, "Drama")],
                                    "film_key int, film_category string")
    long = marts.revenue_by_month_category(b, cat_map)
    got = sorted((r.rental_month, r.film_category, r.revenue) for r in long.collect())
    # film 10 has only NULL amounts: absent; film 11 counts fully in both categories
    assert got == [(D(2005, 5, 1), "Action", 5.0), (D(2005, 5, 1), "Comedy", 5.0),
                   (D(2005, 6, 1), "Action", 5.0), (D(2005, 6, 1), "Comedy", 5.0),
                   (D(2005, 6, 1), "Drama", 2.5), (D(2005, 7, 1), "Drama", 1.25)]
    wide = marts.revenue_pivot(long, ["Action", "Comedy", "Drama", "Horror"])
    rows = {r.rental_month: r for r in wide.collect()}
    assert rows[D(2005, 7, 1)].Action == 0.0 and rows[D(2005, 7, 1)].Horror == 0.0
    total_wide = sum(r.Action + r.Comedy + r.Drama + r.Horror for r in rows.values())
    assert total_wide == sum(x[2] for x in got)


def test_store_performance_labels_and_kpis(spark):
    stores = spark.createDataFrame([(1, 1, None, "Stiles"), (2, 2, "Jon", None)],
                                   "store_key int, store_id int, store_manager_first_name string, "
                                   "store_manager_last_name string")
    perf = marts.store_performance(_base(spark), stores)
    rows = {r.store_key: r for r in perf.collect()}
    assert rows[1].store_label == "Store 1 ( Stiles)"
    assert rows[2].store_label == "Store 2 (Jon )"
    assert rows[3].store_label is None  # unmatched store: NULL-safe, no failure
    assert (rows[1].revenue, rows[1].rentals, rows[1].txns) == (5.0, 3, 3)
    assert abs(rows[1].avg_ticket - 5.0 / 3) < 1e-12
    k = marts.store_kpis(perf).first()
    assert k.total_revenue == 13.75 and k.total_rentals == 6
    assert abs(k.avg_ticket_overall - 13.75 / 6) < 1e-12
    assert abs(k.avg_ticket_unweighted - round((5.0 / 3 + 7.5 / 2 + 1.25) / 3, 6)) < 1e-9


def test_zero_transactions_average_is_null(spark):
    b = _base(spark).withColumn("rental_id", F.lit(None).cast("int"))
    stores = spark.createDataFrame([(1, 1, "a", "b")], "store_key int, store_id int, "
                                   "store_manager_first_name string, store_manager_last_name string")
    rows = marts.store_performance(b, stores).collect()
    assert all(r.txns == 0 and r.avg_ticket is None for r in rows)


def test_inventory_marts(spark):
    util = marts.inventory_utilization(_base(spark))
    assert {r.inventory_id: r.rentals for r in util.collect()} == {100: 2, 101: 1, 102: 2, 103: 1}
    s = marts.inventory_stats(util).first()
    assert (s["items"], s.avg_rentals) == (4, 1.5)
    assert [(r.rentals, r["items"]) for r in marts.inventory_histogram(util).collect()] == [(1, 2), (2, 2)]
    assert [r.inventory_id for r in marts.inventory_top(util, 3).collect()] == [100, 102, 101]


def test_avg_duration_by_category(spark):
    cat_map = spark.createDataFrame([(10, "Action"), (11, "Action"), (12, "Drama")],
                                    "film_key int, film_category string")
    rows = {r.film_category: r.avg_rental_duration
            for r in marts.avg_duration_by_category(_base(spark), cat_map).collect()}
    # film 12 has one NULL duration (dropped) and one 4
    assert rows == {"Action": (3 + 3 + 5 + 5) / 4, "Drama": 4.0}


def test_filter_options_and_bounds(spark):
    stores = spark.createDataFrame([(2,), (None,), (1,), (2,)], "store_id int")
    assert [r.store_id for r in marts.filter_store_options(stores).collect()] == [1, 2]
    empty = spark.createDataFrame([], "date date")
    b = marts.date_bounds(empty).first()
    assert (b.min_date, b.max_date) == (D(2006, 1, 1), D(2006, 12, 31))
    full = marts.date_bounds(spark.createDataFrame([(D(2005, 1, 1),), (D(2006, 3, 1),)], "date date")).first()
    assert (full.min_date, full.max_date) == (D(2005, 1, 1), D(2006, 3, 1))


def test_base_from_fact_has_no_calendar_join(spark):
    fact = spark.createDataFrame([(1, 0, 2.0), (2, 366, 3.0)], "rental_id int, rental_date_key long, dollar_amount double")
    b = marts.base_from_fact(fact, "2005-01-01")
    assert sorted((r.rental_id, r.rental_date) for r in b.collect()) == [(1, D(2005, 1, 1)), (2, D(2006, 1, 2))]
    assert "Join" not in b._jdf.queryExecution().executedPlan().toString()


def test_pivot_fill_generic(spark):
    from starwright.operators.reshape import pivot_fill
    long = spark.createDataFrame([(D(2005, 5, 1), "A", 2), (D(2005, 5, 1), "B", 3), (D(2005, 6, 1), "A", 4)],
                                 "m date, c string, v int")
    rows = {r.m: (r.A, r.B, r.C) for r in pivot_fill(long, "m", "c", "v", ["A", "B", "C"]).collect()}
    assert rows == {D(2005, 5, 1): (2, 3, 0), D(2005, 6, 1): (4, 0, 0)}


def test_avg_duration_with_film_durations(spark):
    cat_map = spark.createDataFrame([(10, "Action"), (11, "Action"), (12, "Drama")],
                                    "film_key int, film_category string")
    durations = spark.createDataFrame([(10, 3), (11, 5), (12, None)], "film_key int, rental_duration int")
    base = _base(spark).drop("rental_duration")
    rows = {r.film_category: r.avg_rental_duration
            for r in marts.avg_duration_by_category(base, cat_map, durations=durations).collect()}
    # film 12 has no duration: its rows drop out, as NULL durations do
    assert rows == {"Action": (3 + 3 + 5 + 5) / 4}


def test_filter_in_and_filter_by(spark):
    from starwright.operators.filters import filter_by, filter_in
    df = spark.range(5000).withColumnRenamed("id", "store_key")
    assert filter_in(df, "store_key", [1, 2, 3]).count() == 3
    assert filter_in(df, "store_key", list(range(0, 3000, 2))).count() == 1500
    assert filter_in(df, "store_key", []).count() == filter_in(df, "store_key", None).count() == 5000
    # the rows of a table select: none of them, no rows
    assert filter_by(df, "store_key", spark.createDataFrame([(1,), (1,), (9000,)], "store_key long")).count() == 1
    assert filter_by(df, "store_key", df.limit(0)).count() == 0
