"""Rental-shaped source tables derived from TPC-H-like order tables.

The warehouse plans read sources shaped like the reference's OLTP schema
(actor, staff, country, city, address, store, customer, film, language,
film category, film actor, rental lines with payment).  This adapter
derives them, lazily and column-pruned, from the order tables the test
data provides:

====================  =========================================================
role                  derived from
====================  =========================================================
actor, staff          supplier: id = s_suppkey, name = s_name split on '#',
                      staff store = s_nationkey
country / city        region / nation
address               customer (id 2*c_custkey) and supplier (id 2*s_suppkey+1)
store                 nations with suppliers; manager = lowest s_suppkey there
customer              customer; active = c_acctbal > 0
film, language        part; language = p_brand; duration = p_size
film category         p_type, plus the first word of p_name (upper-cased), so a
                      film belongs to one or two categories
special features      p_name
film actor            (l_partkey, l_suppkey)
rental line           lineitem joined to orders (and the supplier's nation as
                      store); returned when l_returnflag = 'R', on l_shipdate;
                      payment = l_extendedprice
====================  =========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.sources.tables import TableSource

# FIXED VALUES of the test data: the part types and the first words of part
# names, which together form the category labels.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PART_NAME_WORDS = ["BLUE", "COLD", "HOT", "LARGE", "NEW", "OLD", "RED", "SMALL"]
CATEGORY_LABELS = sorted(set(PART_TYPES) | set(PART_NAME_WORDS))

# Special features found in part names: flag column -> word searched.
PART_FEATURES = {
    "film_has_trailers": "ring",
    "film_has_commentaries": "blue",
    "film_has_deleted_scenes": "bolt",
    "film_has_behind_the_scenes": "widget",
}


def _no_ts() -> F.Column:
    return F.lit(None).cast("timestamp_ntz")


def _first(name: str) -> F.Column:
    return F.split_part(F.col(name), F.lit("#"), F.lit(1))


def _last(name: str) -> F.Column:
    return F.split_part(F.col(name), F.lit("#"), F.lit(2))


class OrderAdapter:
    # Part prices do not fit the rental rate's declared DECIMAL(4,2): the film
    # table of this source declares a wider one.
    wider_types = {"dim_film": {"film_rental_rate": T.DecimalType(12, 2)}}

    def __init__(self, tables: TableSource):
        self.t = tables

    # -- people ------------------------------------------------------------
    def actor(self) -> DataFrame:
        return self.t("supplier", ["s_suppkey", "s_name"]).select(
            F.col("s_suppkey").alias("actor_id"), _first("s_name").alias("first_name"),
            _last("s_name").alias("last_name"), _no_ts().alias("last_update"))

    def staff(self) -> DataFrame:
        return self.t("supplier", ["s_suppkey", "s_name", "s_nationkey"]).select(
            F.col("s_suppkey").alias("staff_id"), _first("s_name").alias("first_name"),
            _last("s_name").alias("last_name"), F.col("s_nationkey").alias("store_id"),
            _no_ts().alias("last_update"))

    def customer(self) -> DataFrame:
        return self.t("customer", ["c_custkey", "c_name", "c_acctbal"]).select(
            F.col("c_custkey").alias("customer_id"), _first("c_name").alias("first_name"),
            _last("c_name").alias("last_name"), F.lit(None).cast("string").alias("email"),
            (F.col("c_acctbal") > 0).alias("active"), F.lit(None).cast("date").alias("create_date"),
            (F.col("c_custkey") * 2).alias("address_id"), _no_ts().alias("last_update"))

    # -- locations ---------------------------------------------------------
    def country(self) -> DataFrame:
        return self.t("region").select(
            F.col("r_regionkey").alias("country_id"), F.col("r_name").alias("country"),
            _no_ts().alias("last_update"))

    def city(self) -> DataFrame:
        return self.t("nation").select(
            F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city"),
            F.col("n_regionkey").alias("country_id"), _no_ts().alias("last_update"))

    def address(self) -> DataFrame:
        cust = self.t("customer", ["c_custkey", "c_name", "c_nationkey"]).select(
            (F.col("c_custkey") * 2).alias("address_id"), F.col("c_name").alias("address"),
            F.col("c_nationkey").alias("city_id"))
        supp = self.t("supplier", ["s_suppkey", "s_name", "s_nationkey"]).select(
            (F.col("s_suppkey") * 2 + 1).alias("address_id"), F.col("s_name").alias("address"),
            F.col("s_nationkey").alias("city_id"))
        return cust.unionByName(supp).select(
            "address_id", "address", F.lit(None).cast("string").alias("postal_code"), "city_id",
            _no_ts().alias("last_update"))

    def store(self) -> DataFrame:
        # One store per nation that has suppliers; partial aggregation keeps
        # the shuffle at one row per (partition, nation).
        managers = self.t("supplier", ["s_suppkey", "s_nationkey"]).groupBy("s_nationkey").agg(
            F.min("s_suppkey").alias("manager_staff_id"))
        return managers.select(
            F.col("s_nationkey").alias("store_id"), "manager_staff_id",
            (F.col("manager_staff_id") * 2 + 1).alias("address_id"), _no_ts().alias("last_update"))

    # -- films -------------------------------------------------------------
    def film(self) -> DataFrame:
        return self.t("part", ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]).select(
            F.col("p_partkey").alias("film_id"), F.col("p_name").alias("title"),
            F.lit(None).cast("string").alias("description"), F.lit(None).cast("int").alias("release_year"),
            F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).try_cast("int").alias("language_id"),
            F.col("p_size").alias("rental_duration"), F.col("p_retailprice").alias("rental_rate"),
            F.col("p_size").alias("length"), F.lit(None).cast("double").alias("replacement_cost"),
            F.col("p_brand").alias("rating"), F.col("p_name").alias("special_features"),
            _no_ts().alias("last_update"))

    def language(self) -> DataFrame:
        return self.t("part", ["p_brand"]).distinct().select(
            F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).try_cast("int").alias("language_id"),
            F.col("p_brand").alias("name"))

    def film_category_names(self) -> DataFrame:
        """(film_id, name): the part type and the upper-cased first word of
        the part name; a film can hold the same label from both."""
        part = self.t("part", ["p_partkey", "p_type", "p_name"])
        word = F.upper(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)))
        return part.select(F.col("p_partkey").alias("film_id"), F.explode(F.array("p_type", word)).alias("name"))

    def film_actor(self) -> DataFrame:
        """(film_id, actor_id) of every line; pairs repeat."""
        return self.t("lineitem", ["l_partkey", "l_suppkey"]).select(
            F.col("l_partkey").alias("film_id"), F.col("l_suppkey").alias("actor_id"))

    # -- rentals -----------------------------------------------------------
    def rental_lines(self, with_store: bool = True, customers: DataFrame | None = None) -> DataFrame:
        """One row per rental line with its payment.

        Columns: rental_id, rental_line, customer_id, staff_id, film_id,
        store_id, rental_date, return_date, amount, inventory_film_id,
        inventory_staff_id, rental_last_update (and customer_key when
        ``customers`` is given).

        ``customers`` (customer_id, customer_key) is looked up on orders,
        before orders meet their lines: that lookup then shuffles the order
        table rather than the four-times larger line table."""
        li = self.t("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                 "l_extendedprice", "l_returnflag", "l_shipdate"])
        od = self.t("orders", ["o_orderkey", "o_custkey", "o_orderdate"])
        extra = []
        if customers is not None:
            ck = customers.select(F.col("customer_id").alias("__cust"), "customer_key")
            od = od.join(ck, od.o_custkey == ck["__cust"], "inner").drop("__cust")
            extra = ["customer_key"]
        lines = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
        if with_store:
            sup = self.t("supplier", ["s_suppkey", "s_nationkey"])
            lines = lines.join(sup, lines.l_suppkey == sup.s_suppkey, "inner")
            store = F.col("s_nationkey")
        else:
            store = F.lit(None).cast("int")
        return lines.select(
            F.col("l_orderkey").alias("rental_id"), F.col("l_linenumber").alias("rental_line"),
            F.col("o_custkey").alias("customer_id"), F.col("l_suppkey").alias("staff_id"),
            F.col("l_partkey").alias("film_id"), store.alias("store_id"),
            F.col("o_orderdate").alias("rental_date"),
            F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("return_date"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_partkey").alias("inventory_film_id"), F.col("l_suppkey").alias("inventory_staff_id"),
            _no_ts().alias("rental_last_update"), *extra)
