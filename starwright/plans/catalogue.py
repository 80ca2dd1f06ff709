"""Registered queries over the test tables, each with a DuckDB oracle.

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole tables (surrogate-key steps run their checkpoint job while the
plan is built).  ``ORACLE_SQL`` holds, per key, SQL computing the same
result on DuckDB views of the same Parquet files.  Oracle hygiene: money
is summed in integer cents, means are integer sums over counts, every
top-k has a unique tie-break, flags are INTEGER 0/1, counts BIGINT.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.functions.flags import contains_flags, null_if_tokens, one_hot
from starwright.functions.text import full_name, is_utf8, repair_utf8, title_label
from starwright.operators import aggregates, calendar, quality
from starwright.operators.defaults import apply_defaults
from starwright.operators.joins import left_join_detail
from starwright.operators.keys import assign_key
from starwright.operators.stable_keys import KeyStore
from starwright.plans import dimensions as dims
from starwright.plans import facts, marts
from starwright.schemas import (
    ADDRESS_KEY_START, CATEGORY_PREFIX, CITY_KEY_START, COUNTRY_KEY_START, FACT_DEFAULTS, category_column,
)
from starwright.session import apply_runtime_conf, ensure_checkpoint_dir
from starwright.sources.bucketed import lookup_bucketed, write_bucketed
from starwright.sources.csv_load import load_csv, profile, read_numbered_fields, reconcile, split_typed
from starwright.sources.order_adapter import CATEGORY_LABELS, PART_FEATURES, PART_TYPES, OrderAdapter
from starwright.sources.sinks import export_tables
from starwright.sources.tables import TableSource

# Dashboard filter used by the base-set marts: order dates and supplier
# nations (stores) chosen as a dashboard user would.
BASE_START, BASE_END = "1996-01-01", "1998-12-31"
BASE_STORES = [1, 2, 3, 5, 8]
# NULL tokens of the token test: the staging profile's list plus one real
# market segment, so the rule visibly fires on the data.
TOKEN_LIST = ["", "NULL", "null", "BUILDING"]

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def _tables(spark: SparkSession, sf_dir: str) -> TableSource:
    """A table source of its own for each query: files are listed anew."""
    apply_runtime_conf(spark)
    return TableSource(spark, sf_dir)


def _src(spark: SparkSession, sf_dir: str) -> OrderAdapter:
    return OrderAdapter(_tables(spark, sf_dir))


def _calendar(a: OrderAdapter) -> tuple[dt.date, dt.date]:
    return calendar.calendar_bounds(a.t("orders", ["o_orderdate"]), "o_orderdate")


# ---------------------------------------------------------------------------
# shared SQL fragments
# ---------------------------------------------------------------------------

def _sql_title(expr: str) -> str:
    return f"(upper(substr({expr}, 1, 1)) || lower(substr({expr}, 2)))"


SQL_CAL = """cal AS (
  SELECT make_date(CAST(min(year(o_orderdate)) AS INTEGER), 1, 1) AS lo,
         make_date(CAST(max(year(o_orderdate)) AS INTEGER), 12, 31) AS hi
  FROM orders)"""

SQL_ADDR = f"""addr AS (
  SELECT address_id, city_id, {ADDRESS_KEY_START - 1} + row_number() OVER (ORDER BY address_id) AS location_address_key
  FROM (SELECT c_custkey * 2 AS address_id, c_nationkey AS city_id FROM customer
        UNION ALL SELECT s_suppkey * 2 + 1, s_nationkey FROM supplier))"""

SQL_CITY = f"""city AS (
  SELECT n.n_nationkey AS location_city_id, n.n_name AS location_city_name,
         {CITY_KEY_START - 1} + row_number() OVER (ORDER BY n.n_nationkey) AS location_city_key,
         c.location_country_key, c.r_name AS location_country_name
  FROM nation n JOIN (SELECT r_regionkey, r_name,
                             {COUNTRY_KEY_START - 1} + row_number() OVER (ORDER BY r_regionkey) AS location_country_key
                      FROM region) c ON n.n_regionkey = c.r_regionkey)"""

SQL_BASE = f"""base AS (
  SELECT l.l_orderkey AS rental_id, o.o_custkey AS customer_id, s.s_nationkey AS store_id,
         l.l_partkey AS film_id, l.l_suppkey AS staff_id, CAST(o.o_orderdate AS DATE) AS rental_date,
         l.l_extendedprice AS payment_amount, 1 AS count_rentals,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE CAST(o.o_orderdate AS DATE) BETWEEN DATE '{BASE_START}' AND DATE '{BASE_END}'
    AND s.s_nationkey IN ({', '.join(str(s) for s in BASE_STORES)}))"""

SQL_MAP = f"""map AS (
  SELECT DISTINCT film_id, film_category FROM (
    SELECT p_partkey AS film_id, {_sql_title('p_type')} AS film_category FROM part
    WHERE p_type IN ({', '.join(repr(x) for x in CATEGORY_LABELS)})
    UNION ALL
    SELECT p_partkey, {_sql_title("split_part(p_name, ' ', 1)")} FROM part
    WHERE upper(split_part(p_name, ' ', 1)) IN ({', '.join(repr(x) for x in CATEGORY_LABELS)})))"""

SQL_STORES = f"""stores AS (
  SELECT m.store_id, m.mgr AS store_manager_staff_id,
         split_part(s.s_name, '#', 1) AS store_manager_first_name,
         split_part(s.s_name, '#', 2) AS store_manager_last_name
  FROM (SELECT s_nationkey AS store_id, min(s_suppkey) AS mgr FROM supplier GROUP BY s_nationkey) m
  JOIN supplier s ON s.s_suppkey = m.mgr)"""


def _sql_date_key(expr: str) -> str:
    return f"CASE WHEN CAST({expr} AS DATE) BETWEEN cal.lo AND cal.hi THEN CAST(date_diff('day', cal.lo, CAST({expr} AS DATE)) AS BIGINT) END"


# ---------------------------------------------------------------------------
# calendar
# ---------------------------------------------------------------------------

@register("dim_date", f"""
WITH {SQL_CAL},
d AS (SELECT cal.lo, CAST(cal.lo + CAST(t.n AS INTEGER) AS DATE) AS d
      FROM cal, range(0, 100000) t(n) WHERE t.n <= date_diff('day', cal.lo, cal.hi))
SELECT CAST(date_diff('day', lo, d) AS BIGINT) AS date_key, d AS "date",
       CAST(date_diff('day', DATE '1970-01-01', d) AS BIGINT) * 86400 AS "timestamp",
       CASE WHEN dayname(d) IN ('Saturday', 'Sunday') THEN 'Weekend' ELSE 'Weekday' END AS weekend,
       dayname(d) AS day_of_week, monthname(d) AS "month", CAST(day(d) AS INTEGER) AS month_day,
       CAST(year(d) AS INTEGER) AS "year", lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') AS week_starting_monday
FROM d""")
def q_dim_date(spark, sf_dir):
    """Calendar spanning the whole years of the order dates."""
    a = _src(spark, sf_dir)
    lo, hi = _calendar(a)
    return calendar.date_dim(spark, lo, hi)


@register("numbers", f"""
WITH {SQL_CAL}
SELECT t.n AS number FROM cal, range(0, 100000) t(n) WHERE t.n <= date_diff('day', cal.lo, cal.hi)""")
def q_numbers(spark, sf_dir):
    """The number helper the calendar is generated from: one number per day
    of the whole years spanned by the order dates (the reference's fixed
    0..9999 helper is covered by unit tests)."""
    lo, hi = _calendar(_src(spark, sf_dir))
    return calendar.numbers(spark, (hi - lo).days + 1)


# ---------------------------------------------------------------------------
# dimensions
# ---------------------------------------------------------------------------

@register("dim_actor", """
SELECT row_number() OVER (ORDER BY s_suppkey) AS actor_key, s_suppkey AS actor_id,
       split_part(s_name, '#', 2) AS actor_last_name, split_part(s_name, '#', 1) AS actor_first_name
FROM supplier""")
def q_dim_actor(spark, sf_dir):
    d = dims.dim_actor(_src(spark, sf_dir).actor())
    return d.select("actor_key", "actor_id", "actor_last_name", "actor_first_name")


@register("dim_staff", """
SELECT row_number() OVER (ORDER BY s_suppkey) AS staff_key, s_suppkey AS staff_id,
       split_part(s_name, '#', 1) AS staff_first_name, split_part(s_name, '#', 2) AS staff_last_name,
       s_nationkey AS staff_store_id
FROM supplier""")
def q_dim_staff(spark, sf_dir):
    d = dims.dim_staff(_src(spark, sf_dir).staff())
    return d.select("staff_key", "staff_id", "staff_first_name", "staff_last_name", "staff_store_id")


@register("dim_country", f"""
SELECT {COUNTRY_KEY_START - 1} + row_number() OVER (ORDER BY r_regionkey) AS location_country_key,
       r_regionkey AS location_country_id, r_name AS location_country_name
FROM region""")
def q_dim_country(spark, sf_dir):
    d = dims.dim_country(_src(spark, sf_dir).country())
    return d.select("location_country_key", "location_country_id", "location_country_name")


@register("dim_city", f"""
WITH {SQL_CITY}
SELECT location_city_key, location_country_key, location_city_id, location_city_name FROM city""")
def q_dim_city(spark, sf_dir):
    a = _src(spark, sf_dir)
    d = dims.dim_city(a.city(), dims.dim_country(a.country()))
    return d.select("location_city_key", "location_country_key", "location_city_id", "location_city_name")


def _addresses(a: OrderAdapter) -> DataFrame:
    return dims.dim_address(a.address(), dims.dim_city(a.city(), dims.dim_country(a.country())))


@register("dim_address", f"""
WITH {SQL_CITY}, {SQL_ADDR}
SELECT addr.location_address_key, city.location_city_key, addr.address_id AS location_address_id
FROM addr JOIN city ON addr.city_id = city.location_city_id""")
def q_dim_address(spark, sf_dir):
    return _addresses(_src(spark, sf_dir)).select("location_address_key", "location_city_key", "location_address_id")


@register("dim_store", f"""
WITH {SQL_ADDR}, {SQL_STORES}
SELECT row_number() OVER (ORDER BY stores.store_id) AS store_key, addr.location_address_key,
       stores.store_id, stores.store_manager_staff_id, stores.store_manager_first_name,
       stores.store_manager_last_name
FROM stores JOIN addr ON addr.address_id = stores.store_manager_staff_id * 2 + 1""")
def q_dim_store(spark, sf_dir):
    a = _src(spark, sf_dir)
    d = dims.dim_store(a.store(), _addresses(a), a.staff())
    return d.select("store_key", "location_address_key", "store_id", "store_manager_staff_id",
                    "store_manager_first_name", "store_manager_last_name")


@register("dim_customer", f"""
WITH {SQL_ADDR}
SELECT row_number() OVER (ORDER BY c.c_custkey) AS customer_key, addr.location_address_key,
       c.c_custkey AS customer_id,
       trim(concat_ws(' ', coalesce(split_part(c.c_name, '#', 1), ''), coalesce(split_part(c.c_name, '#', 2), ''))) AS customer_name,
       CASE WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END AS customer_active
FROM customer c JOIN addr ON addr.address_id = c.c_custkey * 2""")
def q_dim_customer(spark, sf_dir):
    a = _src(spark, sf_dir)
    d = dims.dim_customer(a.customer(), _addresses(a))
    return d.select("customer_key", "location_address_key", "customer_id",
                    full_name("customer_first_name", "customer_last_name").alias("customer_name"),
                    F.col("customer_active").cast("int").alias("customer_active"))


_FEATURE_SQL = ", ".join(
    f"CASE WHEN contains(p_name, '{word}') THEN 1 ELSE 0 END AS {name}" for name, word in PART_FEATURES.items())


@register("feature_flags", f"SELECT p_partkey AS film_id, {_FEATURE_SQL} FROM part")
def q_feature_flags(spark, sf_dir):
    part = _tables(spark, sf_dir)("part", ["p_partkey", "p_name"])
    flags = contains_flags(F.col("p_name"), PART_FEATURES)
    return part.select(F.col("p_partkey").alias("film_id"), *[c.alias(n) for n, c in flags.items()])


_ONE_HOT_SQL = ", ".join(
    f"CASE WHEN p_type = '{lbl}' THEN 1 ELSE 0 END AS {category_column(lbl)}" for lbl in PART_TYPES)


@register("category_one_hot", f"SELECT p_partkey AS film_id, {_ONE_HOT_SQL} FROM part")
def q_category_one_hot(spark, sf_dir):
    part = _tables(spark, sf_dir)("part", ["p_partkey", "p_type"])
    hot = one_hot(F.col("p_type"), PART_TYPES)
    return part.select(F.col("p_partkey").alias("film_id"), *[c.alias(n) for n, c in hot.items()])


def _films(a: OrderAdapter) -> DataFrame:
    return dims.dim_film(a.film(), a.language(), a.film_category_names(), CATEGORY_LABELS, PART_FEATURES)


_CAT_FLAG_SQL = ", ".join(
    f"CASE WHEN p_type = '{lbl}' OR upper(split_part(p_name, ' ', 1)) = '{lbl}' THEN 1 ELSE 0 END AS {category_column(lbl)}"
    for lbl in CATEGORY_LABELS)
_FILM_COLS = (["film_key", "film_id", "film_title", "film_language", "film_rental_duration", "film_rental_rate",
               "film_rating_code"] + list(PART_FEATURES) + [category_column(lbl) for lbl in CATEGORY_LABELS])


@register("dim_film", f"""
SELECT row_number() OVER (ORDER BY p_partkey) AS film_key, p_partkey AS film_id, p_name AS film_title,
       p_brand AS film_language, p_size AS film_rental_duration, p_retailprice AS film_rental_rate,
       p_brand AS film_rating_code, {_FEATURE_SQL}, {_CAT_FLAG_SQL}
FROM part""")
def q_dim_film(spark, sf_dir):
    return _films(_src(spark, sf_dir)).select(*_FILM_COLS)


def _category_map(a: OrderAdapter) -> DataFrame:
    """Category pairs straight from the flags: no film attribute is needed."""
    flags = dims.category_flags(a.film_category_names(), CATEGORY_LABELS)
    return marts.category_map(flags, key="film_id", unique_key=True)


@register("category_map", f"WITH {SQL_MAP} SELECT film_id, film_category FROM map")
def q_category_map(spark, sf_dir):
    return _category_map(_src(spark, sf_dir))


@register("film_actor_bridge", """
SELECT f.film_key, a.actor_key
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) fa
JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS actor_key FROM supplier) a ON fa.l_suppkey = a.s_suppkey
JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS film_key FROM part) f ON fa.l_partkey = f.p_partkey""")
def q_film_actor_bridge(spark, sf_dir):
    a = _src(spark, sf_dir)
    bridge = dims.film_actor_bridge(a.film_actor(), dims.dim_actor(a.actor()), _film_keys(a))
    return bridge.select("film_key", "actor_key")


@register("surrogate_keys", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS order_key, o_orderkey FROM orders""")
def q_surrogate_keys(spark, sf_dir):
    """Distributed numbering, checked against row_number."""
    orders = _tables(spark, sf_dir)("orders", ["o_orderkey"])
    return assign_key(orders, "order_key", "o_orderkey")


# Orders arrive in three loads; each delivers all orders placed before its day.
LOAD_DAYS = ("1993-01-01", "1996-01-01", "9999-01-01")
SQL_LOAD = "CASE " + " ".join(
    f"WHEN CAST(o_orderdate AS DATE) < DATE '{day}' THEN {k + 1}" for k, day in enumerate(LOAD_DAYS)) + " END"


def _keyed_in_loads(spark, sf_dir, id_col: str, key: str) -> DataFrame:
    orders = _tables(spark, sf_dir)("orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    keys = KeyStore(spark, f"{ensure_checkpoint_dir(spark)}/keys-{uuid.uuid4().hex}").table(key, id_col)
    for day in LOAD_DAYS:
        keys.extend(orders.where(F.col("o_orderdate") < F.lit(day).cast("date")))
    return keys.known().select(id_col, key, "key_load")


@register("stable_keys", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {SQL_LOAD}, o_orderkey) AS order_key, {SQL_LOAD} AS key_load
FROM orders""")
def q_stable_keys(spark, sf_dir):
    """Order keys over three loads: earlier keys stay, new orders go on from
    the largest one."""
    return _keyed_in_loads(spark, sf_dir, "o_orderkey", "order_key")


@register("stable_customer_keys", f"""
WITH c AS (SELECT o_custkey, min({SQL_LOAD}) AS key_load FROM orders GROUP BY o_custkey)
SELECT o_custkey, row_number() OVER (ORDER BY key_load, o_custkey) AS customer_key, key_load FROM c""")
def q_stable_customer_keys(spark, sf_dir):
    """Customer keys from the same loads: an id comes again in every load, and
    in many rows of one."""
    return _keyed_in_loads(spark, sf_dir, "o_custkey", "customer_key")


@register("location_rollup", f"""
WITH {SQL_CITY}
SELECT city.location_country_name AS country_name, city.location_city_name AS city_name,
       CAST(count(*) AS BIGINT) AS customers
FROM customer c JOIN city ON c.c_nationkey = city.location_city_id
GROUP BY 1, 2""")
def q_location_rollup(spark, sf_dir):
    a = _src(spark, sf_dir)
    return dims.location_rollup(a.customer(), a.address(), a.city(), a.country())


# ---------------------------------------------------------------------------
# fact
# ---------------------------------------------------------------------------

@register("fact_dates", f"""
WITH {SQL_CAL}
SELECT l.l_orderkey, l.l_linenumber, {_sql_date_key('o.o_orderdate')} AS rental_date_key,
       CASE WHEN l.l_returnflag = 'R' THEN {_sql_date_key('l.l_shipdate')} END AS return_date_key,
       CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS count_returns
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey, cal
WHERE CAST(o.o_orderdate AS DATE) BETWEEN cal.lo AND cal.hi""")
def q_fact_dates(spark, sf_dir):
    a = _src(spark, sf_dir)
    lines = a.rental_lines(with_store=False)
    keyed = facts.date_keys(lines, _calendar(a))
    return keyed.select(F.col("rental_id").alias("l_orderkey"), F.col("rental_line").alias("l_linenumber"),
                        "rental_date_key", "return_date_key", "count_returns")


@register("fact_dates_narrow", f"""
WITH whole AS (SELECT min(year(o_orderdate)) + 1 AS a, max(year(o_orderdate)) - 1 AS b FROM orders),
cal AS (SELECT make_date(CAST(a AS INTEGER), 1, 1) AS lo, make_date(CAST(b AS INTEGER), 12, 31) AS hi FROM whole)
SELECT l.l_orderkey, l.l_linenumber, {_sql_date_key('o.o_orderdate')} AS rental_date_key,
       CASE WHEN l.l_returnflag = 'R' THEN {_sql_date_key('l.l_shipdate')} END AS return_date_key,
       CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS count_returns
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey, cal
WHERE CAST(o.o_orderdate AS DATE) BETWEEN cal.lo AND cal.hi""")
def q_fact_dates_narrow(spark, sf_dir):
    """Date keys over a calendar without the first and last year of the data:
    rentals outside it are dropped, returns outside it get no key."""
    a = _src(spark, sf_dir)
    lo, hi = _calendar(a)
    lines = a.rental_lines(with_store=False)
    keyed = facts.date_keys(lines, (dt.date(lo.year + 1, 1, 1), dt.date(hi.year - 1, 12, 31)))
    return keyed.select(F.col("rental_id").alias("l_orderkey"), F.col("rental_line").alias("l_linenumber"),
                        "rental_date_key", "return_date_key", "count_returns")


@register("left_join_payment", """
SELECT o.o_orderkey, coalesce(l.l_extendedprice, 0.0) AS amount
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def q_left_join_payment(spark, sf_dir):
    t = _tables(spark, sf_dir)
    orders = t("orders", ["o_orderkey"])
    pay = t("lineitem", ["l_orderkey", "l_extendedprice"]).withColumnRenamed("l_orderkey", "o_orderkey")
    joined = left_join_detail(orders, pay, "o_orderkey")
    return joined.select("o_orderkey", F.coalesce(F.col("l_extendedprice"), F.lit(0.0)).alias("amount"))


@register("column_defaults", f"""
SELECT o.o_orderkey, coalesce(l.l_extendedprice, {FACT_DEFAULTS['dollar_amount']}) AS dollar_amount,
       {FACT_DEFAULTS['count_rentals']} AS count_rentals,
       coalesce(CASE WHEN l.l_returnflag = 'R' THEN 1 END, {FACT_DEFAULTS['count_returns']}) AS count_returns
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def q_column_defaults(spark, sf_dir):
    """Declared defaults applied to a left-joined frame: NULL amounts and
    return counts get their defaults, the absent rental count is added."""
    t = _tables(spark, sf_dir)
    orders = t("orders", ["o_orderkey"])
    li = t("lineitem", ["l_orderkey", "l_extendedprice", "l_returnflag"]).withColumnRenamed("l_orderkey", "o_orderkey")
    joined = left_join_detail(orders, li, "o_orderkey").select(
        "o_orderkey", F.col("l_extendedprice").alias("dollar_amount"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).alias("count_returns"))
    return apply_defaults(joined, FACT_DEFAULTS).select("o_orderkey", "dollar_amount", "count_rentals", "count_returns")


@register("fact_rental", f"""
WITH {SQL_CAL},
cust AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS customer_key FROM customer),
staff AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) AS staff_key FROM supplier),
film AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) AS film_key FROM part),
store AS (SELECT store_id, row_number() OVER (ORDER BY store_id) AS store_key
          FROM (SELECT DISTINCT s_nationkey AS store_id FROM supplier))
SELECT l.l_orderkey AS rental_id, cust.customer_key, staff.staff_key, film.film_key, store.store_key,
       {_sql_date_key('o.o_orderdate')} AS rental_date_key,
       CASE WHEN l.l_returnflag = 'R' THEN {_sql_date_key('l.l_shipdate')} END AS return_date_key,
       1 AS count_rentals, CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS count_returns,
       film.p_size AS rental_duration, l.l_extendedprice AS dollar_amount
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN cust ON o.o_custkey = cust.c_custkey
JOIN staff ON l.l_suppkey = staff.s_suppkey
JOIN film ON l.l_partkey = film.p_partkey
JOIN store ON staff.s_nationkey = store.store_id, cal
WHERE CAST(o.o_orderdate AS DATE) BETWEEN cal.lo AND cal.hi""")
def q_fact_rental(spark, sf_dir):
    return _fact(spark, sf_dir).select(
        "rental_id", "customer_key", "staff_key", "film_key", "store_key", "rental_date_key",
        "return_date_key", "count_rentals", "count_returns", "rental_duration", "dollar_amount")


def _fact(spark, sf_dir) -> DataFrame:
    a = _src(spark, sf_dir)
    countries = dims.dim_country(a.country())
    cities = dims.dim_city(a.city(), countries)
    addresses = dims.dim_address(a.address(), cities)
    customers = dims.dim_customer(a.customer(), addresses)
    staff, films = dims.dim_staff(a.staff()), _film_keys(a)
    stores = dims.dim_store(a.store(), addresses, a.staff())
    # Customer keys are resolved on orders, store keys on the staff (whose
    # nation is the store); the lines then meet staff and films by plain
    # equi-joins, whose strategy the planner picks.
    lines = a.rental_lines(with_store=False, customers=customers)
    return facts.build_fact(lines, customers, staff, films, stores, _calendar(a),
                            carry=("inventory_film_id", "inventory_staff_id"), store_from_staff=True)


def _film_keys(a: OrderAdapter) -> DataFrame:
    """film_id, film_key and the allowed days: what the fact takes from the
    film dimension.  Every part has a language, so numbering the ids gives the
    dimension's keys."""
    films = a.film().select("film_id", F.col("rental_duration").alias("film_rental_duration"))
    return assign_key(films, "film_key", "film_id")


@register("fact_bucketed", """
WITH film AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) AS film_key FROM part)
SELECT l.l_orderkey AS rental_id, l.l_linenumber AS rental_line, film.film_key,
       film.p_size AS film_rental_duration, l.l_extendedprice AS dollar_amount
FROM lineitem l LEFT JOIN film ON l.l_partkey = film.p_partkey""")
def q_fact_bucketed(spark, sf_dir):
    """Film keys of all lines, looked up between tables stored in the same
    buckets of the film: the lines move when they are stored, never again."""
    a = _src(spark, sf_dir)
    lines = a.t("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select(
        F.col("l_orderkey").alias("rental_id"), F.col("l_linenumber").alias("rental_line"),
        F.col("l_partkey").alias("film_id"), F.col("l_extendedprice").alias("dollar_amount"))
    root = f"{ensure_checkpoint_dir(spark)}/bucketed-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = write_bucketed(lines, f"{root}/lines", "film_id", buckets)
    films = write_bucketed(_film_keys(a), f"{root}/films", "film_id", buckets, unique=True)
    return lookup_bucketed(stored, films, ["film_key", "film_rental_duration"], "left").drop("film_id")


# ---------------------------------------------------------------------------
# dashboard marts over the filtered base
# ---------------------------------------------------------------------------

def _base(a: OrderAdapter) -> DataFrame:
    """Rental lines in the dashboard's date range and store list.

    The date filter is written on the raw order timestamp (half-open day
    range) so it reaches the Parquet scan; the store list reaches the
    supplier scan."""
    lines = a.rental_lines()
    lo = F.lit(dt.datetime.combine(as_date_py(BASE_START), dt.time())).cast("timestamp_ntz")
    hi = F.lit(dt.datetime.combine(as_date_py(BASE_END) + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")
    lines = lines.where((F.col("rental_date") >= lo) & (F.col("rental_date") < hi))
    base = lines.withColumn("rental_date", F.to_date("rental_date")).withColumnRenamed("amount", "payment_amount") \
        .withColumn("count_rentals", F.lit(1))
    return marts.base_filtered(base, BASE_START, BASE_END, BASE_STORES, store_col="store_id")


def as_date_py(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


@register("base_filtered", f"""
WITH {SQL_BASE}
SELECT rental_id, customer_id, store_id, film_id, rental_date, payment_amount FROM base""")
def q_base_filtered(spark, sf_dir):
    return _base(_src(spark, sf_dir)).select(
        "rental_id", "customer_id", "store_id", "film_id", "rental_date", "payment_amount")


@register("filter_store_options", """
SELECT DISTINCT s_nationkey AS store_id FROM supplier WHERE s_nationkey IS NOT NULL""")
def q_filter_store_options(spark, sf_dir):
    return marts.filter_store_options(_src(spark, sf_dir).store(), "store_id")


@register("date_bounds", """
SELECT CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date FROM orders""")
def q_date_bounds(spark, sf_dir):
    return marts.date_bounds(_tables(spark, sf_dir)("orders", ["o_orderdate"]), "o_orderdate")


@register("top_customers", f"""
WITH {SQL_BASE},
rev AS (SELECT customer_id, CAST(sum(cents) AS DOUBLE) / 100 AS total_revenue FROM base
        WHERE customer_id IS NOT NULL GROUP BY customer_id ORDER BY total_revenue DESC, customer_id LIMIT 10)
SELECT rev.customer_id,
       trim(concat_ws(' ', coalesce(split_part(c.c_name, '#', 1), ''), coalesce(split_part(c.c_name, '#', 2), ''))) AS customer_name,
       rev.total_revenue
FROM rev LEFT JOIN customer c ON c.c_custkey = rev.customer_id""")
def q_top_customers(spark, sf_dir):
    a = _src(spark, sf_dir)
    customers = a.customer().select("customer_id", "first_name", "last_name")
    return marts.top_customers(_base(a), customers, 10, key="customer_id", first="first_name", last="last_name")


@register("revenue_by_month_category", f"""
WITH {SQL_BASE}, {SQL_MAP}
SELECT CAST(date_trunc('month', base.rental_date) AS DATE) AS rental_month, map.film_category,
       CAST(sum(base.cents) AS DOUBLE) / 100 AS revenue
FROM base JOIN map ON base.film_id = map.film_id
GROUP BY 1, 2""")
def q_revenue_by_month_category(spark, sf_dir):
    a = _src(spark, sf_dir)
    return marts.revenue_by_month_category(_base(a), _category_map(a), film="film_id")


_PIVOT_LABELS = [title_label(category_column(lbl), CATEGORY_PREFIX) for lbl in CATEGORY_LABELS]
_PIVOT_SQL = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN film_category = '{lbl}' THEN cents END), 0) AS DOUBLE) / 100 AS \"{lbl}\""
    for lbl in _PIVOT_LABELS)


@register("revenue_pivot", f"""
WITH {SQL_BASE}, {SQL_MAP},
long AS (SELECT CAST(date_trunc('month', base.rental_date) AS DATE) AS rental_month, map.film_category,
                sum(base.cents) AS cents
         FROM base JOIN map ON base.film_id = map.film_id GROUP BY 1, 2)
SELECT rental_month, {_PIVOT_SQL} FROM long GROUP BY rental_month""")
def q_revenue_pivot(spark, sf_dir):
    a = _src(spark, sf_dir)
    long = marts.revenue_by_month_category(_base(a), _category_map(a), film="film_id", ordered=False)
    return marts.revenue_pivot(long, _PIVOT_LABELS)


def _store_lookup(a: OrderAdapter) -> DataFrame:
    staff = a.staff().select(F.col("staff_id").alias("manager_staff_id"), "first_name", "last_name")
    return a.store().join(staff, "manager_staff_id", "inner").select("store_id", "first_name", "last_name")


def _store_performance(a: OrderAdapter) -> DataFrame:
    return marts.store_performance(_base(a), _store_lookup(a), key="store_id", store_id="store_id",
                                   first="first_name", last="last_name")


SQL_PERF = f"""perf AS (
  SELECT b.store_id, CAST(sum(b.cents) AS DOUBLE) / 100 AS revenue, CAST(sum(b.count_rentals) AS BIGINT) AS rentals,
         count(b.rental_id) AS txns, sum(b.cents) AS cents
  FROM base b GROUP BY b.store_id)"""


@register("store_performance", f"""
WITH {SQL_BASE}, {SQL_STORES}, {SQL_PERF}
SELECT perf.store_id,
       trim('Store ' || CAST(perf.store_id AS VARCHAR) || ' (' || coalesce(st.store_manager_first_name, '') || ' '
            || coalesce(st.store_manager_last_name, '') || ')') AS store_label,
       perf.revenue, perf.rentals, perf.txns,
       CASE WHEN perf.txns = 0 THEN NULL ELSE perf.revenue / perf.txns END AS avg_ticket
FROM perf LEFT JOIN stores st ON st.store_id = perf.store_id""")
def q_store_performance(spark, sf_dir):
    return _store_performance(_src(spark, sf_dir))


@register("store_kpis", f"""
WITH {SQL_BASE}, {SQL_PERF}
SELECT CAST(sum(cents) AS DOUBLE) / 100 AS total_revenue, CAST(sum(rentals) AS BIGINT) AS total_rentals,
       round(avg(revenue / txns), 6) AS avg_ticket_unweighted,
       (CAST(sum(cents) AS DOUBLE) / 100) / sum(txns) AS avg_ticket_overall
FROM perf""")
def q_store_kpis(spark, sf_dir):
    return marts.store_kpis(_store_performance(_src(spark, sf_dir)))


_ITEM = ("inventory_film_id", "inventory_staff_id")


def _inventory(spark, sf_dir) -> DataFrame:
    util = marts.inventory_utilization(_base(_src(spark, sf_dir)), _ITEM)
    return util.select(F.col("inventory_film_id").alias("l_partkey"),
                       F.col("inventory_staff_id").alias("l_suppkey"), "rentals")


SQL_INV = "inv AS (SELECT film_id AS l_partkey, staff_id AS l_suppkey, CAST(sum(count_rentals) AS BIGINT) AS rentals FROM base GROUP BY 1, 2)"


@register("inventory_utilization", f"WITH {SQL_BASE}, {SQL_INV} SELECT l_partkey, l_suppkey, rentals FROM inv")
def q_inventory_utilization(spark, sf_dir):
    return _inventory(spark, sf_dir)


@register("inventory_stats", f"""
WITH {SQL_BASE}, {SQL_INV}
SELECT count(*) AS items, CAST(sum(rentals) AS DOUBLE) / count(*) AS avg_rentals FROM inv""")
def q_inventory_stats(spark, sf_dir):
    return marts.inventory_stats(_inventory(spark, sf_dir))


@register("inventory_histogram", f"""
WITH {SQL_BASE}, {SQL_INV}
SELECT rentals, count(*) AS items FROM inv GROUP BY rentals""")
def q_inventory_histogram(spark, sf_dir):
    return marts.inventory_histogram(_inventory(spark, sf_dir))


@register("inventory_top", f"""
WITH {SQL_BASE}, {SQL_INV}
SELECT l_partkey, l_suppkey, rentals FROM inv ORDER BY rentals DESC, l_partkey, l_suppkey LIMIT 25""")
def q_inventory_top(spark, sf_dir):
    return marts.inventory_top(_inventory(spark, sf_dir), 25, ("l_partkey", "l_suppkey"))


@register("avg_duration_by_category", f"""
WITH {SQL_BASE}, {SQL_MAP}
SELECT map.film_category, CAST(sum(p.p_size) AS DOUBLE) / count(*) AS avg_rental_duration
FROM base JOIN map ON base.film_id = map.film_id JOIN part p ON p.p_partkey = base.film_id
WHERE p.p_size IS NOT NULL
GROUP BY map.film_category""")
def q_avg_duration_by_category(spark, sf_dir):
    a = _src(spark, sf_dir)
    durations = a.film().select("film_id", "rental_duration")
    return marts.avg_duration_by_category(_base(a), _category_map(a), film="film_id", durations=durations)


# ---------------------------------------------------------------------------
# loading rules applied to table data
# ---------------------------------------------------------------------------

_TOKENS_SQL = ", ".join(repr(t) for t in TOKEN_LIST)


@register("null_tokens", f"""
SELECT c_custkey, CASE WHEN c_mktsegment IN ({_TOKENS_SQL}) THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def q_null_tokens(spark, sf_dir):
    c = _tables(spark, sf_dir)("customer", ["c_custkey", "c_mktsegment"])
    return c.select("c_custkey", null_if_tokens("c_mktsegment", TOKEN_LIST).alias("c_mktsegment"))


@register("typed_parse", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders""")
def q_typed_parse(spark, sf_dir):
    """Order dates written as text and parsed back with the load profile's
    timestamp pattern."""
    o = _tables(spark, sf_dir)("orders", ["o_orderkey", "o_orderdate"])
    text = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_date"))
    rows, _ = split_typed(text, ["o_orderkey"], T.StructType([T.StructField("order_date", T.TimestampNTZType())]))
    return rows.select("o_orderkey", F.to_date("order_date").alias("order_date"))


@register("load_rejects", """
SELECT o_orderkey, 'raw_value' AS column_name, raw AS raw_value, 'cannot convert to int' AS reason
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS raw
      FROM orders)
WHERE raw IS NOT NULL AND TRY_CAST(raw AS INTEGER) IS NULL""")
def q_load_rejects(spark, sf_dir):
    """A text column that should hold integers; rows that do not convert
    are rejected with column and reason, the rest load."""
    o = _tables(spark, sf_dir)("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"])
    _, rejects = split_typed(_order_text(o), ["o_orderkey"], T.StructType([T.StructField("raw_value", T.IntegerType())]))
    return rejects


def _order_text(o: DataFrame) -> DataFrame:
    """A text column in which partly filled orders hold a word, not a number."""
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
                    .otherwise(F.col("o_custkey").cast("string")).alias("raw_value"))


@register("split_records", """
SELECT doc_id, 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n_lines,
       md5(coalesce(text, '')) AS text_md5
FROM documents""")
def q_split_records(spark, sf_dir):
    """Documents exported as quoted CSV, line breaks and all, and read back in
    splits: the lines of each record and its text."""
    docs = _tables(spark, sf_dir)("documents", ["doc_id", "text"])
    paths = export_tables({"documents": docs}, f"{ensure_checkpoint_dir(spark)}/split-records-{uuid.uuid4().hex}")
    fields = read_numbered_fields(spark, paths["documents"], ["doc_id", "text"], profile("flex").with_options(trim_space=False))
    text = F.coalesce("text", F.lit(""))
    return fields.select(F.col("doc_id").cast("long").alias("doc_id"),
                         (F.regexp_count("raw_record", F.lit("\n")) + 1).cast("long").alias("n_lines"), F.md5(text).alias("text_md5"))


@register("utf8_check", """
SELECT count(*) AS docs, CAST(0 AS BIGINT) AS invalid_docs,
       count(*) FILTER (WHERE contains(text, chr(65533))) AS docs_with_replacement
FROM documents""")
def q_utf8_check(spark, sf_dir):
    """Documents whose text is not valid UTF-8, and documents holding the
    replacement character.  (DuckDB only stores valid UTF-8, hence the
    oracle's constant 0.)"""
    d = _tables(spark, sf_dir)("documents", ["text"])
    return d.agg(F.count(F.lit(1)).alias("docs"),
                 F.count_if(~is_utf8("text")).cast("long").alias("invalid_docs"),
                 F.count_if(F.col("text").contains("�")).cast("long").alias("docs_with_replacement"))


@register("utf8_invalid", """
SELECT count(*) AS docs, count(*) FILTER (WHERE n_chars % 2 = 0) AS invalid_docs,
       count(*) FILTER (WHERE n_chars % 2 = 0) AS repaired_docs
FROM documents""")
def q_utf8_invalid(spark, sf_dir):
    """Every document's bytes, with a byte that no text holds after those of an
    even length: found invalid, and repaired to the text and U+FFFD."""
    d = _tables(spark, sf_dir)("documents", ["text", "n_chars"])
    spoiled = F.concat(F.col("text").cast("binary"),
                       F.when(F.col("n_chars") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit(b"")))
    d = d.select("text", spoiled.alias("data"))
    repaired = repair_utf8("data") == F.concat("text", F.lit("\ufffd"))
    return d.agg(F.count(F.lit(1)).alias("docs"), F.count_if(~is_utf8("data")).cast("long").alias("invalid_docs"),
                 F.count_if(repaired).cast("long").alias("repaired_docs"))


@register("load_reconcile", """
WITH t AS (SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS raw FROM orders),
c AS (SELECT count(*) AS rows_read, count(*) FILTER (WHERE raw IS NULL OR TRY_CAST(raw AS INTEGER) IS NOT NULL) AS rows_loaded,
             count(*) FILTER (WHERE raw IS NOT NULL AND TRY_CAST(raw AS INTEGER) IS NULL) AS rows_rejected FROM t)
SELECT 'orders' AS table_name, rows_read, rows_loaded, rows_rejected,
       rows_read = rows_loaded + rows_rejected AS balanced FROM c""")
def q_load_reconcile(spark, sf_dir):
    """The load of :func:`q_load_rejects` reconciled: the rows of the source,
    of the loaded table and of the rejects are counted apart."""
    o = _tables(spark, sf_dir)("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"])
    rows, rejects = split_typed(_order_text(o), ["o_orderkey"], T.StructType([T.StructField("raw_value", T.IntegerType())]))
    return reconcile("orders", o.agg(F.count(F.lit(1)).alias("rows_read")), rows, rejects, ["o_orderkey"])


# ---------------------------------------------------------------------------
# counts and constraint checks
# ---------------------------------------------------------------------------

ROW_COUNT_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                    "embeddings", "pages", "benchmark", "labels", "conversations"]


@register("row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ROW_COUNT_TABLES))
def q_row_counts(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return aggregates.row_counts({name: t(name) for name in ROW_COUNT_TABLES})


@register("footer_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ROW_COUNT_TABLES))
def q_footer_counts(spark, sf_dir):
    """The counts of :func:`q_row_counts` from the files' footers alone."""
    t = _tables(spark, sf_dir)
    return aggregates.footer_counts(spark, {name: t.path(name) for name in ROW_COUNT_TABLES})


def _sql_content(columns: list[str]) -> str:
    told = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns)
    return f"CAST(coalesce(sum(CAST('0x' || substr(md5({told}), 1, 15) AS BIGINT)), 0) AS VARCHAR)"


@register("load_content", f"""
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s, o_orderpriority AS p,
                  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders),
s AS (SELECT count(*) AS n, {_sql_content(["k", "c", "s", "p", "d"])} AS content FROM o)
SELECT 'orders' AS table_name, n AS rows_source, content AS content_source, n AS rows_target, content AS content_target,
       true AS balanced FROM s""")
def q_load_content(spark, sf_dir):
    """Orders exported to files and loaded back: the content of both."""
    o = _tables(spark, sf_dir)("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])
    o = o.withColumn("o_orderdate", F.to_date("o_orderdate"))
    paths = export_tables({"orders": o}, f"{ensure_checkpoint_dir(spark)}/load-content-{uuid.uuid4().hex}")
    return quality.compare_content("orders", o, load_csv(spark, paths["orders"], o.schema, "format").rows)


@register("check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q_check_unique(spark, sf_dir):
    li = _tables(spark, sf_dir)("lineitem", ["l_orderkey", "l_linenumber"])
    return quality.check_unique(li, ["l_orderkey", "l_linenumber"])


@register("check_orphans", """
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def q_check_orphans(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return quality.check_orphans(t("orders", ["o_orderkey"]), t("lineitem", ["l_orderkey"]),
                                 "o_orderkey", "l_orderkey").select("o_orderkey")


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("check_not_null", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM orders" for c in _ORDER_COLS))
def q_check_not_null(spark, sf_dir):
    return quality.check_not_null(_tables(spark, sf_dir)("orders"), _ORDER_COLS)


@register("check_domain", """
SELECT c_custkey, 'c_name' AS column_name, 'too_long' AS reason FROM customer WHERE length(c_name) > 45
UNION ALL
SELECT c_custkey, 'c_mktsegment', 'too_long' FROM customer WHERE length(c_mktsegment) > 10
UNION ALL
SELECT c_custkey, 'c_acctbal', CASE WHEN TRY_CAST(c_acctbal AS DECIMAL(5,2)) IS NULL THEN 'overflow' ELSE 'scale' END
FROM customer
WHERE c_acctbal IS NOT NULL AND (TRY_CAST(c_acctbal AS DECIMAL(5,2)) IS NULL
      OR CAST(TRY_CAST(c_acctbal AS DECIMAL(5,2)) AS DOUBLE) <> c_acctbal)""")
def q_check_domain(spark, sf_dir):
    c = _tables(spark, sf_dir)("customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    return quality.check_domain(c, "c_custkey", lengths={"c_name": 45, "c_mktsegment": 10},
                                decimals={"c_acctbal": (5, 2)})
