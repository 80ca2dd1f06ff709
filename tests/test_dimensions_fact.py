"""Edge cases of the warehouse build on literal reference-shaped rows."""

import datetime as dt

from pyspark.sql import functions as F

from starwright.plans import dimensions as dims
from starwright.plans import facts

TS = dt.datetime(2006, 2, 15, 4, 57)


def _film(spark):
    film = spark.createDataFrame(
        [(1, "A", 1, 3, 0.99, 90, 20.99, "PG", "Trailers,Commentaries", TS),
         (2, "B", 1, 5, 2.99, 100, 15.99, "G", None, TS),
         (3, "C", 2, 7, 4.99, 80, 9.99, "R", "Deleted Scenes", TS)],
        "film_id int, title string, language_id int, rental_duration int, rental_rate double, length int, "
        "replacement_cost double, rating string, special_features string, last_update timestamp_ntz",
    ).withColumn("description", F.lit(None).cast("string")).withColumn("release_year", F.lit(2006))
    language = spark.createDataFrame([(1, "English"), (2, "Italian")], "language_id int, name string")
    category = spark.createDataFrame([(1, "Action"), (2, "Comedy"), (14, "Sci-Fi")], "category_id int, name string")
    # film 1: two categories, film 2: one, film 3: none
    film_category = spark.createDataFrame([(1, 1), (1, 14), (2, 2)], "film_id int, category_id int")
    return film, language, dims.film_category_names(film_category, category)


def test_dim_film_one_row_per_film(spark):
    film, language, cats = _film(spark)
    d = {r.film_id: r for r in dims.dim_film(film, language, cats).collect()}
    assert sorted(d) == [1, 2, 3]
    assert (d[1].film_in_category_action, d[1].film_in_category_scifi, d[1].film_in_category_comedy) == (1, 1, 0)
    assert (d[2].film_in_category_comedy, d[2].film_in_category_action) == (1, 0)
    assert all(getattr(d[3], c) == 0 for c in d[3].asDict() if c.startswith("film_in_category_"))
    # features bound by name, not by position; NULL text -> 0
    assert (d[1].film_has_trailers, d[1].film_has_commentaries, d[1].film_has_deleted_scenes) == (1, 1, 0)
    assert (d[2].film_has_trailers, d[2].film_has_commentaries) == (0, 0)
    assert d[3].film_has_deleted_scenes == 1
    # rating text carries the special-features text, as in the reference
    assert d[1].film_rating_text == "Trailers,Commentaries"
    assert d[1].film_language == "English" and d[3].film_language == "Italian"
    assert sorted(r.film_key for r in d.values()) == [1, 2, 3]


def test_dim_film_strict_mode_row_shape(spark):
    film, language, cats = _film(spark)
    strict = dims.dim_film(film, language, cats, strict=True)
    counts = {r.film_id: r["count"] for r in strict.groupBy("film_id").count().collect()}
    assert counts == {1: 2, 2: 1}
    assert strict.select("film_key").distinct().count() == 3


def test_category_map_inverts_one_hot(spark):
    from starwright.plans.marts import category_map
    film, language, cats = _film(spark)
    d = dims.dim_film(film, language, cats)
    m = sorted((r.film_id, r.film_category) for r in category_map(d, key="film_id").collect())
    assert m == [(1, "Action"), (1, "Scifi"), (2, "Comedy")]


def test_locations_and_parent_keys(spark):
    country = spark.createDataFrame([(20, "Italy", None), (10, "Chile", None)],
                                    "country_id int, country string, last_update timestamp_ntz")
    city = spark.createDataFrame([(5, "Rome", 20, None), (3, "Lima", 99, None), (1, "Arica", 10, None)],
                                 "city_id int, city string, country_id int, last_update timestamp_ntz")
    countries = dims.dim_country(country)
    assert {r.location_country_id: r.location_country_key for r in countries.collect()} == {10: 110, 20: 111}
    cities = {r.location_city_id: (r.location_city_key, r.location_country_key)
              for r in dims.dim_city(city, countries).collect()}
    # city 3 has no country row: dropped by the inner lookup
    assert cities == {1: (601, 110), 5: (602, 111)}


def test_bridge_and_rollup(spark):
    actor = spark.createDataFrame([(7, "A", "Z", None), (3, "B", "Y", None)],
                                  "actor_id int, first_name string, last_name string, last_update timestamp_ntz")
    film, language, cats = _film(spark)
    film_actor = spark.createDataFrame([(1, 7), (1, 7), (2, 3), (9, 3)], "film_id int, actor_id int")
    bridge = dims.film_actor_bridge(film_actor, dims.dim_actor(actor), dims.dim_film(film, language, cats))
    assert sorted((r.film_key, r.actor_key) for r in bridge.collect()) == [(1, 2), (2, 1)]


def _fact_inputs(spark):
    customers = spark.createDataFrame([(1, 11), (2, 12)], "customer_id int, customer_key long")
    staff = spark.createDataFrame([(1, 21)], "staff_id int, staff_key long")
    films = spark.createDataFrame([(1, 31, 3)], "film_id int, film_key long, film_rental_duration int")
    stores = spark.createDataFrame([(1, 41)], "store_id int, store_key long")
    rental = spark.createDataFrame(
        [(1, dt.datetime(2005, 5, 24, 22, 53), 100, 1, dt.datetime(2005, 5, 26, 22, 4), 1, TS),
         (2, dt.datetime(2005, 5, 24, 23, 3), 100, 2, None, 1, TS),
         (3, dt.datetime(2016, 12, 30, 10, 0), 100, 1, dt.datetime(2017, 1, 2, 9, 0), 1, TS),
         (4, dt.datetime(2004, 12, 31, 10, 0), 100, 1, None, 1, TS)],
        "rental_id int, rental_date timestamp_ntz, inventory_id int, customer_id int, "
        "return_date timestamp_ntz, staff_id int, last_update timestamp_ntz")
    inventory = spark.createDataFrame([(100, 1, 1)], "inventory_id int, film_id int, store_id int")
    payment = spark.createDataFrame([(1, 2.0), (1, 3.0), (3, 1.5), (4, 9.0)], "rental_id int, amount double")
    return customers, staff, films, stores, rental, inventory, payment


def test_fact_edges(spark):
    customers, staff, films, stores, rental, inventory, payment = _fact_inputs(spark)
    lines = facts.rental_lines(rental, inventory, payment)
    cal = (dt.date(2005, 1, 1), dt.date(2017, 1, 1))
    fact = facts.build_fact(lines, customers, staff, films, stores, cal)
    rows = sorted(fact.collect(), key=lambda r: (r.rental_id, r.dollar_amount))
    got = [(r.rental_id, r.rental_date_key, r.return_date_key, r.count_rentals, r.count_returns, r.dollar_amount,
            r.customer_key, r.staff_key, r.film_key, r.store_key, r.rental_duration) for r in rows]
    assert got == [
        # two payments -> two rows
        (1, 143, 145, 1, 1, 2.0, 11, 21, 31, 41, 3),
        (1, 143, 145, 1, 1, 3.0, 11, 21, 31, 41, 3),
        # no payment -> kept once with the 0.0 default; not returned -> NULL key, count 0
        (2, 143, None, 1, 0, 0.0, 12, 21, 31, 41, 3),
        # returned after the calendar end -> NULL key but counted as returned
        (3, 4381, None, 1, 1, 1.5, 11, 21, 31, 41, 3),
        # rental 4 (2004-12-31) lies before the calendar: dropped
    ]
    assert fact.where("rental_last_update IS NULL").count() == 0
    assert sorted({(r.rental_id, r.actual_days) for r in rows}) == [(1, 2), (2, None), (3, 3)]


def test_payment_pre_aggregation_keeps_rental_grain(spark):
    _, _, _, _, _, _, payment = _fact_inputs(spark)
    agg = {r.rental_id: r.amount for r in facts.payment_per_rental(payment).collect()}
    assert agg == {1: 5.0, 3: 1.5, 4: 9.0}


def test_date_key_join_equals_arithmetic(spark):
    from starwright.operators.calendar import date_dim
    lines = spark.createDataFrame(
        [(1, dt.datetime(2005, 5, 24, 22, 53), dt.datetime(2005, 5, 26, 1, 0)),
         (2, dt.datetime(2005, 12, 31, 23, 59), None),
         (3, dt.datetime(2006, 6, 1, 0, 0), dt.datetime(2006, 6, 3, 0, 0)),
         (4, dt.datetime(2004, 12, 31, 0, 0), None)],
        "rental_id int, rental_date timestamp_ntz, return_date timestamp_ntz")
    cal = (dt.date(2005, 1, 1), dt.date(2005, 12, 31))
    by_math = facts.date_keys(lines, cal).select("rental_id", "rental_date_key", "return_date_key")
    joined = facts.date_key_join(lines, date_dim(spark, *cal), "rental_date", "rental_date_key", "inner")
    joined = facts.date_key_join(joined, date_dim(spark, *cal), "return_date", "return_date_key", "left")
    by_join = joined.select("rental_id", "rental_date_key", "return_date_key")
    assert sorted(by_math.collect()) == sorted(by_join.collect())
    assert sorted(r.rental_id for r in by_join.collect()) == [1, 2]
