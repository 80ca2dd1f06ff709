"""Dimension builders over rental-shaped source tables.

Each builder is a lazy plan except for the surrogate-key step, which pins
its numbering with a reliable checkpoint (see ``operators.keys``).  A child
dimension resolves its parent's key by joining the parent dimension, in
the dependency order country -> city -> address -> store / customer.
``number`` gives the keys: ``assign_key`` numbers each build anew,
``operators.stable_keys.KeyStore.assign`` keeps the keys of earlier builds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.functions.flags import contains_flags, one_hot
from starwright.operators.defaults import apply_defaults
from starwright.operators.keys import assign_key
from starwright.schemas import (
    ADDRESS_KEY_START, CITY_KEY_START, COUNTRY_KEY_START, FILM_CATEGORIES, FILM_FEATURES, category_column,
)

NOW = "CURRENT_TIMESTAMP"


def dim_actor(actor: DataFrame, number=assign_key) -> DataFrame:
    src = actor.select(
        F.col("actor_id"), F.col("first_name").alias("actor_first_name"),
        F.col("last_name").alias("actor_last_name"), F.col("last_update").alias("actor_last_update"))
    keyed = number(src, "actor_key", "actor_id")
    return apply_defaults(keyed, {"actor_last_update": NOW})


def dim_staff(staff: DataFrame, number=assign_key) -> DataFrame:
    src = staff.select(
        F.col("staff_id"), F.col("first_name").alias("staff_first_name"),
        F.col("last_name").alias("staff_last_name"), F.col("store_id").alias("staff_store_id"),
        F.col("last_update").alias("staff_last_update"))
    keyed = number(src, "staff_key", "staff_id")
    return apply_defaults(keyed, {"staff_last_update": NOW})


def dim_country(country: DataFrame, start: int = COUNTRY_KEY_START, number=assign_key) -> DataFrame:
    src = country.select(
        F.col("country_id").alias("location_country_id"), F.col("country").alias("location_country_name"),
        F.col("last_update").alias("location_country_last_update"))
    keyed = number(src, "location_country_key", "location_country_id", start=start)
    return apply_defaults(keyed, {"location_country_last_update": NOW})


def dim_city(city: DataFrame, countries: DataFrame, start: int = CITY_KEY_START, number=assign_key) -> DataFrame:
    """City with its country's key.  The source-country table is not joined:
    the country dimension already carries the id it would match."""
    parent = countries.select("location_country_id", "location_country_key")
    src = city.join(parent, city.country_id == parent.location_country_id, "inner").select(
        "location_country_key", F.col("city_id").alias("location_city_id"),
        F.col("city").alias("location_city_name"), F.col("last_update").alias("location_city_last_update"))
    keyed = number(src, "location_city_key", "location_city_id", start=start)
    return apply_defaults(keyed, {"location_city_last_update": NOW})


def dim_address(address: DataFrame, cities: DataFrame, start: int = ADDRESS_KEY_START, number=assign_key) -> DataFrame:
    parent = cities.select("location_city_id", "location_city_key")
    src = address.join(parent, address.city_id == parent.location_city_id, "inner").select(
        "location_city_key", F.col("address_id").alias("location_address_id"),
        F.col("address").alias("location_address"), F.col("postal_code").alias("location_address_postal_code"),
        F.col("last_update").alias("location_address_last_update"))
    keyed = number(src, "location_address_key", "location_address_id", start=start)
    return apply_defaults(keyed, {"location_address_last_update": NOW})


def dim_store(store: DataFrame, addresses: DataFrame, staff: DataFrame, number=assign_key) -> DataFrame:
    """Store with its address key and its manager's names."""
    addr = addresses.select("location_address_id", "location_address_key")
    mgr = staff.select(F.col("staff_id").alias("__mgr_id"), F.col("first_name").alias("store_manager_first_name"),
                       F.col("last_name").alias("store_manager_last_name"))
    src = (
        store.join(addr, store.address_id == addr.location_address_id, "inner")
        .join(mgr, F.col("manager_staff_id") == F.col("__mgr_id"), "inner")
        .select("location_address_key", F.col("last_update").cast("string").alias("store_last_update"),
                "store_id", F.col("manager_staff_id").alias("store_manager_staff_id"),
                "store_manager_first_name", "store_manager_last_name")
    )
    keyed = number(src, "store_key", "store_id")
    return apply_defaults(keyed, {"store_last_update": "CURRENT_TIMESTAMP"}).withColumn(
        "store_last_update", F.col("store_last_update").cast("string"))


def dim_customer(customer: DataFrame, addresses: DataFrame, number=assign_key) -> DataFrame:
    addr = addresses.select("location_address_id", "location_address_key")
    src = customer.join(addr, customer.address_id == addr.location_address_id, "inner").select(
        "location_address_key", F.col("last_update").alias("customer_last_update"), "customer_id",
        F.col("first_name").alias("customer_first_name"), F.col("last_name").alias("customer_last_name"),
        F.col("email").alias("customer_email"), F.col("active").alias("customer_active"),
        F.col("create_date").alias("customer_created"))
    keyed = number(src, "customer_key", "customer_id")
    return apply_defaults(keyed, {"customer_last_update": NOW})


def film_category_names(film_category: DataFrame, category: DataFrame) -> DataFrame:
    """(film_id, name) from the film-category bridge and category table."""
    return film_category.join(category, "category_id", "inner").select("film_id", "name")


def category_flags(categories: DataFrame, labels: Sequence[str] = FILM_CATEGORIES) -> DataFrame:
    """One row per film with a category: film_id and one 0/1 column per label,
    folded from (film_id, name) memberships by one shuffle on the film."""
    hot = one_hot(F.col("name"), labels)
    return categories.groupBy("film_id").agg(*[F.max(c).alias(n) for n, c in hot.items()])


def film_flags(
    film: DataFrame,
    language: DataFrame,
    categories: DataFrame,
    labels: Sequence[str] = FILM_CATEGORIES,
    features: Mapping[str, str] = FILM_FEATURES,
    strict: bool = False,
) -> DataFrame:
    """Film attributes, language name, feature flags and one 0/1 column per
    category label, without the surrogate key.

    Default: one row per film; a film in several categories has several
    flags set, a film in none keeps all flags 0 (category memberships are
    folded with ``max`` per film, then left-joined).
    ``strict=True`` reproduces the reference's row shape instead: one row
    per (film, category) membership, films without a category dropped.
    """
    lang = language.select("language_id", F.col("name").alias("film_language"))
    base = film.join(lang, "language_id", "inner")
    attrs = [
        "film_id", F.col("last_update").alias("film_last_update"), F.col("title").alias("film_title"),
        F.col("description").alias("film_description"), F.col("release_year").alias("film_release_year"),
        "film_language", F.col("rental_duration").alias("film_rental_duration"),
        F.col("rental_rate").alias("film_rental_rate"), F.col("length").alias("film_duration"),
        F.col("replacement_cost").alias("film_replacement_cost"), F.col("rating").alias("film_rating_code"),
        # The reference stores the special-features text as the rating text.
        F.col("special_features").alias("film_rating_text"),
    ]
    feature_cols = contains_flags(F.col("special_features"), features)
    flag_names = [category_column(lbl) for lbl in labels]
    if strict:
        member = categories.select("film_id", F.col("name").alias("__cat"))
        return base.join(member, "film_id", "inner").select(
            *attrs, *[c.alias(n) for n, c in feature_cols.items()],
            *[c.alias(n) for n, c in one_hot(F.col("__cat"), labels).items()])
    return base.join(category_flags(categories, labels), "film_id", "left").select(
        *attrs, *[c.alias(n) for n, c in feature_cols.items()],
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in flag_names])


def dim_film(
    film: DataFrame,
    language: DataFrame,
    categories: DataFrame,
    labels: Sequence[str] = FILM_CATEGORIES,
    features: Mapping[str, str] = FILM_FEATURES,
    strict: bool = False,
    number=assign_key,
) -> DataFrame:
    """:func:`film_flags` with ``film_key`` (ordered by film id, then by the
    category flags in strict mode)."""
    src = film_flags(film, language, categories, labels, features, strict)
    order = ["film_id"] + ([category_column(lbl) for lbl in labels] if strict else [])
    keyed = number(src, "film_key", order)
    return apply_defaults(keyed, {"film_last_update": NOW})


def film_actor_bridge(film_actor: DataFrame, actors: DataFrame, films: DataFrame) -> DataFrame:
    """Distinct (film_key, actor_key) pairs; weights are left NULL.  This is the
    only place that removes repeated pairs.  With a
    strict-mode film dimension (one row per film category) each film row
    gets the film's actors, as in the reference."""
    a = actors.select("actor_id", "actor_key")
    f = films.select("film_id", "film_key")
    pairs = film_actor.select("film_id", "actor_id").distinct()
    return (
        pairs.join(a, "actor_id", "inner").join(f, "film_id", "inner")
        .select("film_key", "actor_key", F.lit(None).cast("decimal(3,2)").alias("actor_weighing_factor"))
    )


def location_rollup(customer: DataFrame, address: DataFrame, city: DataFrame, country: DataFrame) -> DataFrame:
    """Customers per (country, city) through the normalised location hierarchy
    of source tables.

    Customers are counted by the city of their address, so that after partial
    aggregation one row per city and task meets the names."""
    of_city = customer.select("address_id").join(address.select("address_id", "city_id"), "address_id")
    per_city = of_city.groupBy("city_id").agg(F.count(F.lit(1)).alias("customers"))
    return (
        per_city.join(city.select("city_id", "country_id", F.col("city").alias("city_name")), "city_id")
        .join(country.select("country_id", F.col("country").alias("country_name")), "country_id")
        .select("country_name", "city_name", F.col("customers").cast("long").alias("customers"))
    )
