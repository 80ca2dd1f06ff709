"""End-to-end warehouse builds: on the test tables through the order
adapter, and on reference-shaped tables through RentalTables."""

import datetime as dt
import os

import pytest

from pyspark.sql import types as T

from starwright.plans.warehouse import build_warehouse, check_warehouse
from starwright.schemas import WAREHOUSE
from starwright.sources.order_adapter import CATEGORY_LABELS, PART_FEATURES, OrderAdapter
from starwright.sources.rental_tables import RentalTables
from starwright.sources.tables import TableSource

SF = "/root/testdata/sf0.001"
TS = dt.datetime(2006, 2, 15, 4, 57, 20)


@pytest.fixture(scope="module")
def order_wh(spark):
    import tempfile
    src = OrderAdapter(TableSource(spark, SF))
    return build_warehouse(spark, src, tempfile.mkdtemp(prefix="starwright-owh-"), ("1995-01-01", "2002-12-31"),
                           CATEGORY_LABELS, PART_FEATURES, store_from_staff=True,
                           carry=("inventory_film_id", "inventory_staff_id"))


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
def test_build_on_order_tables(spark, order_wh):
    wh = order_wh
    lineitems = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert wh.read("fact_rental").count() == lineitems
    assert wh.read("dim_date").count() == 2922
    assert wh.read("numbers").count() == 10000
    report = {(r.table_name, r.check, r.column_name): r.violations for r in check_warehouse(wh).collect()}
    # every foreign key resolves and every NOT NULL column is filled
    assert all(v == 0 for (t, c, col), v in report.items() if c in ("foreign_key", "not_null"))
    # surrogate keys are unique; the fact's rental id (an order key) is not
    assert report[("dim_customer", "primary_key", "customer_key")] == 0
    assert report[("fact_rental", "primary_key", "rental_id")] > 0
    # part prices do not fit the declared DECIMAL(4,2) rental rate
    assert report[("dim_film", "domain", "film_rental_rate")] > 0
    assert not [k for k in report if k[1] == "absent" and k[0] != "dim_film"]  # its labels are the parts' own
    # every table has its declared columns and types, the film rate a wider one
    for name in wh.paths:
        if name not in ("dim_film", "fact_rental"):
            assert [(f.name, f.dataType) for f in wh.read(name).schema] == [
                (f.name, f.dataType) for f in WAREHOUSE[name].schema], name
    assert wh.read("dim_film").schema["film_rental_rate"].dataType == T.DecimalType(12, 2)


def _write_reference_tables(spark, root):
    t = {
        "actor": ([(1, "ANNA", "BERG", TS), (2, "OMAR", "DIAZ", TS)],
                  "actor_id long, first_name string, last_name string, last_update timestamp_ntz"),
        "staff": ([(1, "Mia", "Holt", 1, TS), (2, "Jon", "Park", 2, TS)],
                  "staff_id long, first_name string, last_name string, store_id long, last_update timestamp_ntz"),
        "country": ([(1, "Norway", TS), (2, "Chile", TS)], "country_id long, country string, last_update timestamp_ntz"),
        "city": ([(10, "Bergen", 1, TS), (20, "Arica", 2, TS)],
                 "city_id long, city string, country_id long, last_update timestamp_ntz"),
        "address": ([(1, "1 North Road", None, 10, TS), (2, "2 South Road", None, 20, TS),
                     (5, "3 East Road", "35200", 10, TS)],
                    "address_id long, address string, postal_code string, city_id long, last_update timestamp_ntz"),
        "store": ([(1, 1, 1, TS), (2, 2, 2, TS)], "store_id long, manager_staff_id long, address_id long, last_update timestamp_ntz"),
        "customer": ([(1, "ANN", "LEE", "a@x", 1, dt.date(2006, 2, 14), 5, TS)],
                     "customer_id long, first_name string, last_name string, email string, active int, "
                     "create_date date, address_id long, last_update timestamp_ntz"),
        "film": ([(1, "FILM ONE", "d", 2006, 1, 6, 0.99, 86, 20.99, "PG", "Deleted Scenes,Behind the Scenes", TS),
                  (2, "FILM TWO", "d", 2006, 1, 3, 4.99, 48, 12.99, "G", "Trailers,Deleted Scenes", TS)],
                 "film_id long, title string, description string, release_year int, language_id long, "
                 "rental_duration int, rental_rate double, length int, replacement_cost double, rating string, "
                 "special_features string, last_update timestamp_ntz"),
        "language": ([(1, "English")], "language_id long, name string"),
        "category": ([(6, "Documentary"), (11, "Horror")], "category_id long, name string"),
        "film_category": ([(1, 6), (2, 11)], "film_id long, category_id long"),
        "film_actor": ([(1, 1), (2, 1), (2, 2)], "film_id long, actor_id long"),
        "inventory": ([(1, 1, 1), (2, 2, 2)], "inventory_id long, film_id long, store_id long"),
        "rental": ([(1, dt.datetime(2005, 5, 24, 22, 53, 30), 1, 1, dt.datetime(2005, 5, 26, 22, 4, 30), 1, TS),
                    (2, dt.datetime(2005, 5, 24, 22, 54, 33), 2, 1, None, 2, TS)],
                   "rental_id long, rental_date timestamp_ntz, inventory_id long, customer_id long, "
                   "return_date timestamp_ntz, staff_id long, last_update timestamp_ntz"),
        "payment": ([(1, 2.99), (2, 0.99), (2, 1.00)], "rental_id long, amount double"),
    }
    for name, (rows, ddl) in t.items():
        spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{root}/{name}.parquet")


@pytest.fixture(scope="module")
def ref_wh(spark):
    """One warehouse built from the reference-shaped fixture, shared by the
    tests that only read it."""
    import tempfile
    root = tempfile.mkdtemp(prefix="starwright-wh-")
    src_root = os.path.join(root, "src")
    _write_reference_tables(spark, src_root)
    return build_warehouse(spark, RentalTables(TableSource(spark, src_root)), os.path.join(root, "dw"),
                           ("2005-01-01", "2017-01-01"), count_drops=True)


def test_build_on_reference_shaped_tables(ref_wh):
    wh = ref_wh
    assert wh.dropped_fact_rows == 0
    fact = sorted(wh.read("fact_rental").collect(), key=lambda r: (r.rental_id, r.dollar_amount))
    assert [(r.rental_id, r.rental_date_key, r.return_date_key, r.count_returns, r.dollar_amount, r.inventory_id)
            for r in fact] == [(1, 143, 145, 1, 2.99, 1), (2, 143, None, 0, 0.99, 2), (2, 143, None, 0, 1.0, 2)]
    film = {r.film_id: r for r in wh.read("dim_film").collect()}
    assert (film[1].film_has_deleted_scenes, film[1].film_has_trailers, film[1].film_in_category_documentary) == (1, 0, 1)
    assert film[2].film_in_category_horror == 1
    assert [r.location_country_key for r in wh.read("dim_location_country").orderBy("location_country_id").collect()] == [110, 111]
    assert wh.read("dim_date").count() == 4384
    report = {(r.table_name, r.check, r.column_name): r.violations for r in check_warehouse(wh).collect()}
    assert all(v == 0 for (t, c, col), v in report.items() if c == "foreign_key")
    # two payments for rental 2 break the declared rental_id key (kept, reported)
    assert report[("fact_rental", "primary_key", "rental_id")] == 2


def test_dashboard_over_written_warehouse(ref_wh):
    from starwright.plans.marts import SECTIONS, dashboard
    wh = ref_wh
    out = dashboard(wh.read("fact_rental"), wh.read("dim_customer"), wh.read("dim_store"), wh.read("dim_film"),
                    "2005-01-01", "2005-01-01", "2006-12-31", store_ids=[2], sections=SECTIONS)
    top = out["Top 10 customers by revenue"].collect()
    assert [(r.customer_name, r.total_revenue) for r in top] == [("ANN LEE", 1.99)]
    perf = out["Store performance"].collect()
    assert [(r.store_id, r.store_label, r.txns) for r in perf] == [(2, "Store 2 (Jon Park)", 2)]
    cats = {(r.film_category, r.revenue) for r in out["Monthly revenue trend by category"].collect()}
    assert cats == {("Horror", 1.99)}
    pivot = out["Monthly revenue trend by category (pivot)"].first()
    assert pivot.Horror == 1.99 and pivot.Documentary == 0.0
    assert out["Inventory utilization (stats)"].first()["items"] == 1
    assert {r.film_category for r in out["Avg rental duration by category"].collect()} == {"Horror"}


def test_export_and_reload_reconciles(spark, tmp_dir, ref_wh):
    """Every table comes back as it was written (empty text is NULL and outer
    blanks are trimmed, as the profile says)."""
    from starwright.plans.migration import export_warehouse, exported_rows, load_exported
    wh = ref_wh
    paths = export_warehouse(wh, os.path.join(tmp_dir, "export"))
    assert set(paths) == set(WAREHOUSE)
    tables, report = load_exported(spark, paths, os.path.join(tmp_dir, "back"), exported=exported_rows(wh, list(paths)))
    rows = {r.table_name: r for r in report.collect()}
    for name, r in rows.items():
        assert r.balanced and r.rows_rejected == 0, name
        written = wh.read(name).select(*[f.name for f in WAREHOUSE[name].schema])
        assert r.rows_read == written.count(), name
        assert tables[name].exceptAll(written).count() == 0 == written.exceptAll(tables[name]).count(), name


def test_written_schemas(ref_wh):
    for name in ref_wh.paths:
        want = [(f.name, f.dataType) for f in WAREHOUSE[name].schema]
        got = [(f.name, f.dataType) for f in ref_wh.read(name).schema if f.name != "inventory_id"]
        assert sorted(got, key=str) == sorted(want, key=str), name


def test_absent_column_and_repeated_date_are_reported(spark, tmp_dir, ref_wh):
    from starwright.plans.warehouse import Warehouse
    wh = Warehouse(spark, tmp_dir)
    dates = ref_wh.read("dim_date")
    dates.unionByName(dates.limit(1)).drop("weekend").write.parquet(wh.path("dim_date"))
    wh.paths["dim_date"] = wh.path("dim_date")
    report = {(r.check, r.column_name): r.violations for r in check_warehouse(wh).collect()}
    assert report[("absent", "weekend")] == 1 and report[("unique", "date")] == 2 == report[("primary_key", "date_key")]


def test_dashboard_edge_cases(spark):
    """Unknown stores, upper-case flag columns, a label with a digit, a store
    whose amounts are all NULL."""
    from starwright.plans.marts import SECTIONS, dashboard
    fact = spark.createDataFrame(
        [(1, 1, 1, 1, 10, 10.0, 1, 3, 7), (2, 1, 2, 1, 10, 5.5, 1, 3, 7), (3, 2, 1, 2, 11, None, 1, 4, 8)],
        "rental_id long, customer_key long, film_key long, store_key long, rental_date_key long, dollar_amount double, "
        "count_rentals int, rental_duration int, inventory_id long")
    customers = spark.createDataFrame([(1, "A", "B"), (2, "C", "D")],
                                      "customer_key long, customer_first_name string, customer_last_name string")
    stores = spark.createDataFrame([(1, 501, "M", "N"), (2, 502, None, None)],
                                   "store_key long, store_id long, store_manager_first_name string, store_manager_last_name string")
    films = spark.createDataFrame([(1, 1, 0, 1), (2, 0, 1, 0)],
                                  "film_key long, FILM_IN_CATEGORY_ACTION int, film_in_category_80s int, Film_In_Category_sci_fi int")
    run = lambda ids: dashboard(fact, customers, stores, films, "2005-01-01", "2005-01-01", "2005-12-31",
                                store_ids=ids, sections=SECTIONS)
    assert all(run([999])[s].count() == 0 for s in SECTIONS)
    for ids in (None, []):
        out = run(ids)
        perf = {r.store_id: (r.revenue, r.txns, r.avg_ticket) for r in out["Store performance"].collect()}
        assert perf == {501: (15.5, 2, 7.75), 502: (0.0, 1, 0.0)}
        long = {(r.film_category, r.revenue) for r in out["Monthly revenue trend by category"].collect()}
        assert long == {("Action", 10.0), ("80s", 5.5), ("Sci_fi", 10.0)}
        wide = out["Monthly revenue trend by category (pivot)"].first().asDict()
        assert {k: v for k, v in wide.items() if k != "rental_month"} == {"Action": 10.0, "80s": 5.5, "Sci_fi": 10.0}
    assert {r.store_id for r in run([502])["Store performance"].collect()} == {502}


def test_command_line(spark, tmp_dir, capsys):
    from starwright.__main__ import main
    src_root = os.path.join(tmp_dir, "src")
    _write_reference_tables(spark, src_root)
    out = os.path.join(tmp_dir, "dw")
    assert main(["build", src_root, out, "--calendar", "2005-01-01", "2017-01-01"], spark=spark) == 0
    assert main(["check", out], spark=spark) == 0
    assert main(["dashboard", out, "--calendar-start", "2005-01-01", "--range", "2005-01-01", "2006-12-31"],
                spark=spark) == 0
    text = capsys.readouterr().out
    assert "fact_rental" in text and "primary_key" in text and "== Store performance" in text


def test_dashboard_date_range_reaches_the_fact_scan(spark, tmp_dir):
    import contextlib
    import io
    from starwright.plans.marts import base_filtered, base_from_fact
    path = os.path.join(tmp_dir, "fact")
    spark.createDataFrame([(1, 0, 1, 2.0), (2, 143, 1, 3.0), (3, 500, 2, 4.0)],
                          "rental_id long, rental_date_key long, store_key long, dollar_amount double") \
        .write.parquet(path)
    base = base_filtered(base_from_fact(spark.read.parquet(path), "2005-01-01", "2005-05-01", "2006-02-28"),
                         "2005-05-01", "2006-02-28", [1], store_col="store_key")
    assert [r.rental_id for r in base.collect()] == [2]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        base.explain("formatted")
    pushed = [line for line in buf.getvalue().splitlines() if "PushedFilters" in line][0]
    assert "GreaterThanOrEqual(rental_date_key,120)" in pushed and "LessThanOrEqual(rental_date_key,423)" in pushed


def test_payments_per_rental_keeps_rental_grain(spark, tmp_dir):
    src_root = os.path.join(tmp_dir, "src")
    _write_reference_tables(spark, src_root)
    wh = build_warehouse(spark, RentalTables(TableSource(spark, src_root), payments_per_rental=True),
                         os.path.join(tmp_dir, "dw"), ("2005-01-01", "2017-01-01"))
    fact = sorted((r.rental_id, r.dollar_amount) for r in wh.read("fact_rental").collect())
    assert fact == [(1, 2.99), (2, 1.99)]
    report = {(r.table_name, r.check, r.column_name): r.violations for r in check_warehouse(wh).collect()}
    assert report[("fact_rental", "primary_key", "rental_id")] == 0


def test_dropped_rentals_are_counted(spark, tmp_dir):
    src_root = os.path.join(tmp_dir, "src")
    _write_reference_tables(spark, src_root)
    # a calendar that starts after the first rental day drops all three lines
    wh = build_warehouse(spark, RentalTables(TableSource(spark, src_root)), os.path.join(tmp_dir, "dw"),
                         ("2005-06-01", "2017-01-01"), count_drops=True)
    assert wh.read("fact_rental").count() == 0 and wh.dropped_fact_rows == 3


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
def test_export_rejects_values_that_do_not_fit(spark, tmp_dir, order_wh):
    """Part prices exceed the declared DECIMAL(4,2) rental rate: the export
    writes them as they are and the reload rejects those film rows, with
    the reconciliation still balanced."""
    from starwright.plans.migration import export_warehouse, load_exported
    paths = export_warehouse(order_wh, os.path.join(tmp_dir, "export"), ["dim_film", "dim_customer"])
    root = os.path.join(tmp_dir, "back")
    tables, report = load_exported(spark, paths, root)
    rows = {r.table_name: r for r in report.collect()}
    films = order_wh.read("dim_film").count()
    assert rows["dim_film"].balanced and rows["dim_film"].rows_rejected == films and tables["dim_film"].count() == 0
    assert rows["dim_customer"].rows_rejected == 0
    reasons = {(r.column_name, r.reason) for r in spark.read.parquet(f"{root}/rejects/dim_film").collect()}
    assert reasons == {("film_rental_rate", "cannot convert to decimal(4,2)")}
