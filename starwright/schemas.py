"""Warehouse table schemas, constraint specs and the fixed values the
warehouse must reproduce.

ids are LongType like the surrogate keys (ids outgrow INT at scale), flags are stored as integers 0/1 in query outputs, money is
DoubleType stored but summed exactly in cents, ISO week is a zero-padded
two-character string, and the epoch second column is a LongType.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the reference warehouse's values.
# ---------------------------------------------------------------------------

# Film category labels, in the order the film dimension declares its
# one-hot columns.
FILM_CATEGORIES = [
    "Action", "Animation", "Children", "Classics", "Comedy", "Documentary",
    "Drama", "Family", "Foreign", "Games", "Horror", "Music", "New",
    "Sci-Fi", "Sports", "Travel",
]

# Special-feature flags: output column -> substring searched in the
# special-features text.
FILM_FEATURES = {
    "film_has_trailers": "Trailers",
    "film_has_commentaries": "Commentaries",
    "film_has_deleted_scenes": "Deleted Scenes",
    "film_has_behind_the_scenes": "Behind the Scenes",
}

# Prefix of the one-hot category columns of the film dimension.
CATEGORY_PREFIX = "film_in_category_"

# Day names counted as weekend, and the two labels of the weekend column
# (the second is also the declared column default).
WEEKEND_DAYS = ["Saturday", "Sunday"]
WEEKEND_LABEL = "Weekend"
WEEKDAY_LABEL = "Weekday"

# Reference calendar: inclusive bounds of the date dimension.
REFERENCE_CALENDAR = ("2005-01-01", "2017-01-01")

# First surrogate key of the location tables (AUTO_INCREMENT start values).
COUNTRY_KEY_START = 110
CITY_KEY_START = 601
ADDRESS_KEY_START = 604

# Number helper: 10 digits cross-joined four times gives 0..9999.
NUMBERS_SIZE = 10000

# Fallback date bounds of the dashboard when the calendar is empty.
FALLBACK_DATE_RANGE = ("2006-01-01", "2006-12-31")

# Text values treated as true by the dashboard's category melt.
TRUTHY_TEXT = ["1", "True", "TRUE", "true"]

# Declared column defaults of the fact and date tables.
FACT_DEFAULTS = {"count_rentals": 1, "count_returns": 0, "dollar_amount": 0.0}
DATE_DEFAULTS = {"weekend": WEEKDAY_LABEL}

# ---------------------------------------------------------------------------


def category_column(label: str) -> str:
    """One-hot column name of a category label: lower case, letters and
    digits only, e.g. 'Sci-Fi' -> 'film_in_category_scifi'."""
    return CATEGORY_PREFIX + "".join(ch for ch in label.lower() if ch.isalnum())


@dataclass(frozen=True)
class TableSpec:
    """Declared shape and constraints of one warehouse table."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    # column -> (parent table, parent column)
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)
    # column -> max characters (VARCHAR(n) / CHAR(n))
    lengths: dict[str, int] = field(default_factory=dict)
    # column -> (precision, scale)
    decimals: dict[str, tuple[int, int]] = field(default_factory=dict)

    @property
    def not_null(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


L, I, S, D, TS, DB = (T.LongType(), T.IntegerType(), T.StringType(), T.DateType(),
                      T.TimestampNTZType(), T.DoubleType())
BOOL = T.BooleanType()

DIM_ACTOR = TableSpec(
    "dim_actor",
    _s(("actor_key", L, False), ("actor_last_update", TS, False), ("actor_id", L, False),
       ("actor_last_name", S, False), ("actor_first_name", S, False)),
    primary_key=("actor_key",),
    lengths={"actor_last_name": 45, "actor_first_name": 45},
)

DIM_COUNTRY = TableSpec(
    "dim_location_country",
    _s(("location_country_key", L, False), ("location_country_id", L, False),
       ("location_country_last_update", TS, False), ("location_country_name", S, False)),
    primary_key=("location_country_key",),
    lengths={"location_country_name": 50},
)

DIM_CITY = TableSpec(
    "dim_location_city",
    _s(("location_city_key", L, False), ("location_country_key", L, False),
       ("location_city_name", S, False), ("location_city_id", L, False),
       ("location_city_last_update", TS, False)),
    primary_key=("location_city_key",),
    foreign_keys={"location_country_key": ("dim_location_country", "location_country_key")},
    lengths={"location_city_name": 50},
)

DIM_ADDRESS = TableSpec(
    "dim_location_address",
    _s(("location_address_key", L, False), ("location_city_key", L, False),
       ("location_address_id", L, False), ("location_address_last_update", TS, False),
       ("location_address", S, False), ("location_address_postal_code", S, True)),
    primary_key=("location_address_key",),
    foreign_keys={"location_city_key": ("dim_location_city", "location_city_key")},
    lengths={"location_address": 64, "location_address_postal_code": 10},
)

DIM_CUSTOMER = TableSpec(
    "dim_customer",
    _s(("customer_key", L, False), ("location_address_key", L, False),
       ("customer_last_update", TS, False), ("customer_id", L, True),
       ("customer_first_name", S, True), ("customer_last_name", S, True),
       ("customer_email", S, True), ("customer_active", BOOL, True),
       ("customer_created", D, True), ("customer_version_number", I, True),
       ("customer_valid_from", D, True), ("customer_valid_through", D, True)),
    primary_key=("customer_key",),
    foreign_keys={"location_address_key": ("dim_location_address", "location_address_key")},
    lengths={"customer_first_name": 45, "customer_last_name": 45, "customer_email": 50},
)

_FILM_FIELDS = [
    ("film_key", L, False), ("film_last_update", TS, False), ("film_id", L, False),
    ("film_title", S, False), ("film_description", S, True), ("film_release_year", I, True),
    ("film_language", S, False), ("film_rental_duration", I, True),
    ("film_rental_rate", T.DecimalType(4, 2), True), ("film_duration", I, True),
    ("film_replacement_cost", T.DecimalType(5, 2), True), ("film_rating_code", S, True),
    ("film_rating_text", S, True),
] + [(name, I, True) for name in FILM_FEATURES] + [
    (category_column(label), I, True) for label in FILM_CATEGORIES
]

DIM_FILM = TableSpec(
    "dim_film",
    _s(*_FILM_FIELDS),
    primary_key=("film_key",),
    lengths={"film_title": 64, "film_language": 20, "film_rating_code": 5,
             "film_rating_text": 255},
    decimals={"film_rental_rate": (4, 2), "film_replacement_cost": (5, 2)},
)

DIM_FILM_ACTOR_BRIDGE = TableSpec(
    "dim_film_actor_bridge",
    _s(("film_key", L, False), ("actor_key", L, False),
       ("actor_weighing_factor", T.DecimalType(3, 2), True)),
    primary_key=("film_key", "actor_key"),
    foreign_keys={"film_key": ("dim_film", "film_key"), "actor_key": ("dim_actor", "actor_key")},
    decimals={"actor_weighing_factor": (3, 2)},
)

DIM_STAFF = TableSpec(
    "dim_staff",
    _s(("staff_key", L, False), ("staff_last_update", TS, False), ("staff_id", L, True),
       ("staff_first_name", S, True), ("staff_last_name", S, True), ("staff_store_id", L, True),
       ("staff_version_number", I, True), ("staff_valid_from", D, True),
       ("staff_valid_through", D, True), ("staff_active", BOOL, True)),
    primary_key=("staff_key",),
    lengths={"staff_first_name": 45, "staff_last_name": 45},
)

DIM_STORE = TableSpec(
    "dim_store",
    _s(("store_key", L, False), ("location_address_key", L, False),
       ("store_last_update", S, False), ("store_id", L, True),
       ("store_manager_staff_id", L, True), ("store_manager_first_name", S, True),
       ("store_manager_last_name", S, True), ("store_version_number", I, True),
       ("store_valid_from", D, True), ("store_valid_through", D, True)),
    primary_key=("store_key",),
    foreign_keys={"location_address_key": ("dim_location_address", "location_address_key")},
    lengths={"store_manager_first_name": 45, "store_manager_last_name": 45},
)

DIM_DATE = TableSpec(
    "dim_date",
    _s(("date_key", L, False), ("date", D, False), ("timestamp", L, True),
       ("weekend", S, False), ("day_of_week", S, True), ("month", S, True),
       ("month_day", I, True), ("year", I, True), ("week_starting_monday", S, True)),
    primary_key=("date_key",),
    unique=(("date",),),
    lengths={"weekend": 10, "day_of_week": 10, "month": 10, "week_starting_monday": 2},
)

NUMBERS = TableSpec("numbers", _s(("number", L, True)))
NUMBERS_SMALL = TableSpec("numbers_small", _s(("number", I, True)))

FACT_RENTAL = TableSpec(
    "fact_rental",
    _s(("rental_id", L, False), ("rental_last_update", TS, False),
       ("customer_key", L, False), ("staff_key", L, False), ("film_key", L, False),
       ("store_key", L, False), ("rental_date_key", L, False), ("return_date_key", L, True),
       ("count_rentals", I, False), ("count_returns", I, False),
       ("rental_duration", I, False), ("dollar_amount", DB, False),
       # ours: days actually rented, NULL until returned
       ("actual_days", I, True)),
    primary_key=("rental_id",),
    foreign_keys={
        "customer_key": ("dim_customer", "customer_key"),
        "staff_key": ("dim_staff", "staff_key"),
        "film_key": ("dim_film", "film_key"),
        "store_key": ("dim_store", "store_key"),
        "rental_date_key": ("dim_date", "date_key"),
        "return_date_key": ("dim_date", "date_key"),
    },
)

WAREHOUSE = {
    spec.name: spec
    for spec in (DIM_ACTOR, DIM_COUNTRY, DIM_CITY, DIM_ADDRESS, DIM_CUSTOMER, DIM_FILM,
                 DIM_FILM_ACTOR_BRIDGE, DIM_STAFF, DIM_STORE, DIM_DATE, NUMBERS,
                 NUMBERS_SMALL, FACT_RENTAL)
}
