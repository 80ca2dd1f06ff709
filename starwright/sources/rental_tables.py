"""Source reader for tables already in the reference's OLTP shape.

Tables (one Parquet folder each): actor, staff, country, city, address,
store, customer, film, language, category, film_category, film_actor,
inventory, rental, payment.  Offers the same methods as
:class:`~starwright.sources.order_adapter.OrderAdapter`, so the warehouse
build runs unchanged on either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.plans.facts import payment_per_rental, rental_lines
from starwright.sources.tables import TableSource


class RentalTables:
    """``payments_per_rental=True`` sums a rental's payments first (exact
    cents), so the fact keeps one row per rental and its declared
    ``rental_id`` key holds; by default each payment is its own fact row,
    as in the reference."""

    def __init__(self, tables: TableSource, payments_per_rental: bool = False):
        self.t = tables
        self.payments_per_rental = payments_per_rental

    def actor(self) -> DataFrame:
        return self.t("actor", ["actor_id", "first_name", "last_name", "last_update"])

    def staff(self) -> DataFrame:
        return self.t("staff", ["staff_id", "first_name", "last_name", "store_id", "last_update"])

    def customer(self) -> DataFrame:
        return self.t("customer", ["customer_id", "first_name", "last_name", "email", "active", "create_date",
                                   "address_id", "last_update"]).withColumn(
            "active", F.col("active").cast("string").isin("1", "true", "True", "TRUE", "yes"))

    def country(self) -> DataFrame:
        return self.t("country", ["country_id", "country", "last_update"])

    def city(self) -> DataFrame:
        return self.t("city", ["city_id", "city", "country_id", "last_update"])

    def address(self) -> DataFrame:
        return self.t("address", ["address_id", "address", "postal_code", "city_id", "last_update"])

    def store(self) -> DataFrame:
        return self.t("store", ["store_id", "manager_staff_id", "address_id", "last_update"])

    def film(self) -> DataFrame:
        return self.t("film", ["film_id", "title", "description", "release_year", "language_id", "rental_duration",
                               "rental_rate", "length", "replacement_cost", "rating", "special_features",
                               "last_update"])

    def language(self) -> DataFrame:
        return self.t("language", ["language_id", "name"])

    def film_category_names(self) -> DataFrame:
        fc = self.t("film_category", ["film_id", "category_id"])
        return fc.join(self.t("category", ["category_id", "name"]), "category_id", "inner").select("film_id", "name")

    def film_actor(self) -> DataFrame:
        return self.t("film_actor", ["film_id", "actor_id"])

    def rental_lines(self, with_store: bool = True, customers: DataFrame | None = None) -> DataFrame:
        rental = self.t("rental", ["rental_id", "rental_date", "inventory_id", "customer_id", "return_date",
                                   "staff_id", "last_update"])
        if customers is not None:
            ck = customers.select(F.col("customer_id").alias("__cust"), "customer_key")
            rental = rental.join(ck, rental.customer_id == ck["__cust"], "inner").drop("__cust")
        payment = self.t("payment", ["rental_id", "amount"])
        if self.payments_per_rental:
            payment = payment_per_rental(payment)
        return rental_lines(rental, self.t("inventory", ["inventory_id", "film_id", "store_id"]), payment)
