"""Content fingerprints, counts from footers and declared catalogue tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from starwright.operators.aggregates import footer_counts, row_counts
from starwright.operators.quality import compare_content, content_sum

ROWS = [(1, "a", 1.5, dt.date(2020, 1, 1)), (2, None, None, None), (2, None, None, None), (3, "", 0.0, None)]
DDL = "id long, name string, amount double, day date"


def content(spark, rows, ddl=DDL):
    return tuple(content_sum(spark.createDataFrame(rows, ddl).repartition(3)).first())


def test_content_is_of_the_rows_alone(spark):
    base = content(spark, ROWS)
    assert base[0] == 4 and content(spark, ROWS[::-1]) == base
    changed = [
        [*ROWS[:3], (3, "", 0.5, None)],            # a value
        [*ROWS[:3], (3, None, 0.0, None)],          # empty is not NULL
        [ROWS[0], ROWS[1], ROWS[3], ROWS[3]],       # other rows repeat
        [(1, "a", 1.5, dt.date(2020, 1, 2)), *ROWS[1:]]]
    sums = [content(spark, r) for r in changed]
    assert {s[0] for s in sums} == {4} and base not in sums and len(set(sums)) == len(sums)
    two = "x string, y string"
    assert content(spark, [("ab", "c")], two) != content(spark, [("a", "bc")], two)
    assert content(spark, [("1:a", "")], two) != content(spark, [("", "1:a")], two)
    assert content(spark, []) == (0, "0")


def test_one_altered_value_is_unbalanced(spark):
    a = spark.createDataFrame(ROWS, DDL)
    b = a.withColumn("name", F.when(F.col("id") == 1, "b").otherwise(F.col("name")))
    same, other = compare_content("t", a, a.repartition(4)).first(), compare_content("t", a, b).first()
    assert same["balanced"] and same["rows_source"] == 4
    assert not other["balanced"] and other["rows_source"] == other["rows_target"]
    assert compare_content("t", a, b, ["id", "day"]).first()["balanced"]


def test_exported_warehouse_keeps_its_content(spark, tmp_dir):
    from test_warehouse import _write_reference_tables

    from starwright.plans.migration import compare_exported, export_warehouse, load_exported
    from starwright.plans.warehouse import build_warehouse
    from starwright.sources.rental_tables import RentalTables
    from starwright.sources.sinks import write_table
    from starwright.sources.tables import TableSource
    import os

    os.makedirs(f"{tmp_dir}/src")
    _write_reference_tables(spark, f"{tmp_dir}/src")
    wh = build_warehouse(spark, RentalTables(TableSource(spark, f"{tmp_dir}/src")), f"{tmp_dir}/dw", ("2005-01-01", "2006-12-31"))
    names = ["dim_actor", "dim_staff", "dim_location_country", "dim_date"]
    tables, _ = load_exported(spark, export_warehouse(wh, f"{tmp_dir}/csv", names), f"{tmp_dir}/back")
    report = {r["table_name"]: r for r in compare_exported(wh, tables).collect()}
    assert sorted(report) == sorted(names) and all(r["balanced"] for r in report.values()), report
    changed = tables["dim_actor"].withColumn("actor_last_name", F.concat("actor_last_name", F.lit("x")))
    write_table(changed, f"{tmp_dir}/back/dim_actor")
    again = compare_exported(wh, {"dim_actor": spark.read.parquet(f"{tmp_dir}/back/dim_actor")}).first()
    assert not again["balanced"] and again["rows_source"] == again["rows_target"]


def test_counts_come_from_footers(spark, tmp_dir):
    paths = {}
    for name, n in (("some", 1000), ("none", 0)):
        paths[name] = f"{tmp_dir}/{name}"
        spark.range(n).select("id", F.lit("x" * 50).alias("wide")).repartition(5).write.parquet(paths[name])
    counts = footer_counts(spark, paths)
    assert [tuple(r) for r in counts.collect()] == [("none", 0), ("some", 1000)]
    assert counts.collect() == row_counts({n: spark.read.parquet(p) for n, p in paths.items()}).collect()
    plan = counts._jdf.queryExecution().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") >= 2 and "ReadSchema: struct<count(*)" in plan
    # the session that asked still reads as before
    assert "BatchScan" not in spark.read.parquet(paths["some"])._jdf.queryExecution().toString()
