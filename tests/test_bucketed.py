"""Lookups between tables stored in the same buckets: the rows of the lines are
not moved, hot ids included, and the result is that of a plain join."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from starwright.operators.joins import lookup_key
from starwright.sources.bucketed import _name, lookup_bucketed, read_bucketed, write_bucketed
from test_skew import conf

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def lines(spark, n=6000):
    """A third of the lines have id 7, some none, some one that the dimension lacks."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("line"), F.when(i % 3 == 0, F.lit(7)).when(i % 50 == 1, F.lit(None)).otherwise(i % 400).cast("long").alias("film_id"),
        F.repeat(F.lit("x"), (i % 5).cast("int")).alias("hot"))


def films(spark):
    return spark.range(350).select(F.col("id").alias("film_id"), (F.col("id") + 1000).alias("film_key"),
                                   F.concat(F.lit("t"), F.col("id")).alias("title"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture()
def stored(spark, tmp_dir):
    return (write_bucketed(lines(spark), f"{tmp_dir}/lines", "film_id", 8),
            write_bucketed(films(spark), f"{tmp_dir}/films", "film_id", 8, unique=True))


def test_equals_a_plain_lookup(spark, stored):
    for how in ("inner", "left"):
        got = lookup_bucketed(*stored, ["film_key", "title"], how)
        want = lookup_key(lines(spark), films(spark), "film_id", "film_id", ["film_key", "title"], how)
        assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(stored[0].rows()) == rows(lines(spark)) and rows(stored[1].rows()) == rows(films(spark))


def test_lines_are_not_moved(spark, stored):
    with conf(spark, NO_BROADCAST):
        even = lookup_bucketed(*stored, "film_key")
        text = plan(even)
        # No exchange of lines: those there are bring the few hot ids' dimension rows.
        assert "SortMergeJoin" in text and "Bucketed: true" in text
        assert "hashpartitioning" not in text and "rangepartitioning" not in text and "RoundRobin" not in text
        plain = lookup_key(lines(spark), films(spark), "film_id", "film_id", "film_key")
        assert "hashpartitioning" in plan(plain)
        assert rows(even) == rows(plain)


def test_hot_ids_lie_beside_the_buckets(spark, stored):
    own = stored[0]
    assert rows(own.hot) == [(7,)]
    beside = {r.film_id for r in own.beside.select("film_id").distinct().collect()}
    assert beside == {7, None}
    largest = own.even.groupBy("film_id").count().agg(F.max("count")).first()[0]
    assert largest * 8 <= own.rows().count()
    assert stored[1].hot.count() == 0


def test_a_later_session_finds_the_table(spark, stored, tmp_dir):
    path = f"{tmp_dir}/lines"
    spark.sql(f"DROP TABLE {_name(path)}")  # files stay: it is external
    again = read_bucketed(spark, path)
    assert (again.on, again.buckets) == ("film_id", 8) and rows(again.rows()) == rows(lines(spark))
    with conf(spark, NO_BROADCAST):
        assert "hashpartitioning" not in plan(lookup_bucketed(again, stored[1], "film_key"))


def test_empty_tables_and_wrong_use(spark, stored, tmp_dir):
    none = write_bucketed(lines(spark).limit(0), f"{tmp_dir}/none", "film_id", 8)
    assert rows(lookup_bucketed(none, stored[1], "film_key")) == []
    no_films = write_bucketed(films(spark).limit(0), f"{tmp_dir}/no-films", "film_id", 8, unique=True)
    assert lookup_bucketed(stored[0], no_films, "film_key").count() == 0
    assert lookup_bucketed(stored[0], no_films, "film_key", "left").where("film_key IS NULL").count() == 6000
    other = write_bucketed(films(spark), f"{tmp_dir}/other", "film_id", 4, unique=True)
    with pytest.raises(ValueError):
        lookup_bucketed(stored[0], other, "film_key")
    with pytest.raises(ValueError):
        lookup_bucketed(*stored, "film_key", "right")


def test_fact_from_bucketed_lookups(spark, tmp_dir):
    """A fact whose film keys were resolved in buckets is the fact of plain lookups."""
    from starwright.plans import catalogue, facts
    from starwright.plans.dimensions import dim_address, dim_city, dim_country, dim_customer, dim_staff, dim_store

    a = catalogue._src(spark, "/root/testdata/sf0.001")
    addresses = dim_address(a.address(), dim_city(a.city(), dim_country(a.country())))
    customers, staff = dim_customer(a.customer(), addresses), dim_staff(a.staff())
    stores, keys = dim_store(a.store(), addresses, a.staff()), catalogue._film_keys(a)
    rentals = a.rental_lines(customers=customers)
    build = lambda x: facts.build_fact(x, customers, staff, keys, stores, catalogue._calendar(a)).drop(
        "rental_last_update")
    stored = write_bucketed(rentals, f"{tmp_dir}/rentals", "film_id", 4)
    resolved = lookup_bucketed(stored, write_bucketed(keys, f"{tmp_dir}/keys", "film_id", 4, unique=True),
                               ["film_key", "film_rental_duration"])
    assert rows(build(resolved)) == rows(build(rentals))
