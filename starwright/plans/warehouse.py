"""Whole warehouse build: every dimension, the bridge and the fact, written
in dependency order, then validated against the declared constraints.

Each keyed table is written and read back before a child uses it: the
written table cuts the lineage (a lost executor recomputes from storage,
not from the sources) and fixes the keys children see.  Use a shared
folder (object store / HDFS) as ``out_root`` on a cluster.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.operators import quality
from starwright.operators.calendar import date_dim, numbers, numbers_small
from starwright.operators.defaults import apply_defaults
from starwright.operators.keys import assign_key
from starwright.operators.stable_keys import KeyStore
from starwright.plans import dimensions as dims
from starwright.plans import facts
from starwright.schemas import DATE_DEFAULTS, FILM_CATEGORIES, FILM_FEATURES, WAREHOUSE, category_column
from starwright.sources.publish import read_published
from starwright.sources.sinks import write_table


class Warehouse:
    """Tables written under one root, readable by name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.paths: dict[str, str] = {}
        # Rental lines the fact dropped (rental date outside the calendar or
        # a dimension row missing); set when the build is asked to count.
        self.dropped_fact_rows: int | None = None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = (),
              schema: T.StructType | None = None) -> DataFrame:
        """Create or replace a table with its declared columns and types (or
        ``schema``).  A value that does not fit its type fails the write."""
        write_table(df, self.path(name), schema or (WAREHOUSE[name].schema if name in WAREHOUSE else None), partition_by)
        self.paths[name] = self.path(name)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.stored(name).drop(facts.PERIOD)

    def stored(self, name: str) -> DataFrame:
        """The table with the column its files are laid out by, if it has one:
        a date range then reads only the folders of its periods."""
        return read_published(self.spark, self.path(name))


def table_schema(name: str, df: DataFrame, labels: Sequence[str] = FILM_CATEGORIES,
                 features: Mapping[str, str] = FILM_FEATURES, carry: Sequence[str] = (),
                 wider: Mapping[str, Mapping[str, T.DataType]] | None = None) -> T.StructType:
    """Declared schema of a table for one build: the film table's flag columns
    follow the build's labels and features, the fact gets the carried columns
    (typed as they come), and ``wider`` replaces declared types that the
    source's values do not fit."""
    fields = list(WAREHOUSE[name].schema.fields)
    if name == "dim_film":
        own = [category_column(lbl) for lbl in labels]
        flags = [T.StructField(c, T.IntegerType(), True) for c in [*features, *own]]
        fixed = set(FILM_FEATURES) | {category_column(lbl) for lbl in FILM_CATEGORIES}
        fields = [f for f in fields if f.name not in fixed] + flags
    fields += [df.schema[c] for c in carry]
    changed = (wider or {}).get(name, {})
    return T.StructType([T.StructField(f.name, changed.get(f.name, f.dataType), f.nullable) for f in fields])


def build_warehouse(
    spark: SparkSession,
    src,
    out_root: str,
    calendar: tuple[str | dt.date, str | dt.date],
    labels: Sequence[str] = FILM_CATEGORIES,
    features: Mapping[str, str] = FILM_FEATURES,
    strict_film: bool = False,
    store_from_staff: bool = False,
    carry: Sequence[str] = ("inventory_id",),
    count_drops: bool = False,
    keys: KeyStore | None = None,
) -> Warehouse:
    """Build every warehouse table from a rental-shaped source (``RentalTables``
    or ``OrderAdapter``) into ``out_root``, with the declared columns and types
    (a source may declare ``wider_types`` for values that do not fit).

    With ``keys``, a build over what an earlier one left keeps its surrogate
    keys and numbers only new ids; tables are replaced one by one, each as a
    whole."""
    number = keys.assign if keys else assign_key
    wh = Warehouse(spark, out_root)
    lo = dt.date.fromisoformat(calendar[0]) if isinstance(calendar[0], str) else calendar[0]
    hi = dt.date.fromisoformat(calendar[1]) if isinstance(calendar[1], str) else calendar[1]

    wh.write("numbers_small", numbers_small(spark))
    wh.write("numbers", numbers(spark))
    wh.write("dim_date", apply_defaults(date_dim(spark, lo, hi), DATE_DEFAULTS))

    wh.write("dim_actor", dims.dim_actor(src.actor(), number=number))
    staff = wh.write("dim_staff", dims.dim_staff(src.staff(), number=number))
    countries = wh.write("dim_location_country", dims.dim_country(src.country(), number=number))
    cities = wh.write("dim_location_city", dims.dim_city(src.city(), countries, number=number))
    addresses = wh.write("dim_location_address", dims.dim_address(src.address(), cities, number=number))
    stores = wh.write("dim_store", dims.dim_store(src.store(), addresses, src.staff(), number=number))
    customers = wh.write("dim_customer", dims.dim_customer(src.customer(), addresses, number=number))
    films = dims.dim_film(src.film(), src.language(), src.film_category_names(), labels, features, strict=strict_film,
                          number=number)
    wider = getattr(src, "wider_types", None)
    films = wh.write("dim_film", films, schema=table_schema("dim_film", films, labels, features, wider=wider))
    wh.write("dim_film_actor_bridge", dims.film_actor_bridge(src.film_actor(), wh.read("dim_actor"), films))

    lines = src.rental_lines(with_store=not store_from_staff, customers=customers)
    fact = facts.build_fact(lines, customers, staff, films, stores, (lo, hi), carry=carry,
                            store_from_staff=store_from_staff)
    # Partitioned by periods of the rental date and sorted inside: a date range
    # reads only the folders of its periods.
    schema = table_schema("fact_rental", fact, carry=carry, wider=wider).add(facts.PERIOD, T.IntegerType())
    wh.write("fact_rental", facts.by_period(fact), [facts.PERIOD], schema)
    if count_drops:
        # One extra pass over the source lines; the fact count reads the
        # written files.
        wh.dropped_fact_rows = src.rental_lines(with_store=not store_from_staff).count() - \
            wh.read("fact_rental").count()
    return wh


def check_warehouse(wh: Warehouse) -> DataFrame:
    """One row per check: (table_name, check, column_name, violations) for
    primary and unique keys (Q1), foreign keys (Q2), NOT NULL columns (Q3) and
    declared lengths / decimals (Q4) of every written table.  A declared column
    that is absent counts as one violation of the check ``absent``.  All foreign
    keys of a table are checked in one pass, and so are its columns."""
    spark = wh.spark
    rows = []
    for name in sorted(wh.paths):
        spec = WAREHOUSE.get(name)
        if spec is None:
            continue
        df = wh.read(name)
        cols = set(df.columns)
        rows += [(name, "absent", f.name, 1) for f in spec.schema.fields if f.name not in cols]
        keys = [("primary_key", spec.primary_key)] if spec.primary_key else []
        for check, key in keys + [("unique", u) for u in spec.unique]:
            if set(key) <= cols:
                dup = quality.check_unique(df, list(key)).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
                rows.append((name, check, ",".join(key), int(dup)))
        references = {col: (wh.read(parent), pcol) for col, (parent, pcol) in spec.foreign_keys.items()
                      if col in cols and parent in wh.paths}
        if references:
            for r in quality.orphan_counts(df, references).collect():
                rows.append((name, "foreign_key", r.column_name, int(r.violations)))
        nn = [c for c in spec.not_null if c in cols]
        lengths = {c: n for c, n in spec.lengths.items() if c in cols}
        decimals = {c: ps for c, ps in spec.decimals.items()
                    if c in cols and df.schema[c].dataType.typeName() in ("double", "float", "decimal")}
        if nn or lengths or decimals:
            # NOT NULL and domain counts share one pass over the table.
            for r in quality.violation_counts(df, nn, lengths, decimals).collect():
                rows.append((name, r.check, r.column_name, int(r.violations)))
    return spark.createDataFrame(rows, "table_name string, check string, column_name string, violations long")
