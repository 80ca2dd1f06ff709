import datetime as dt

from pyspark.sql import functions as F

from starwright.functions import (
    calendar_columns, date_key, epoch_seconds, full_name, is_truthy, iso_week, money_sum, money_text, month_start,
    null_if_tokens, safe_div, store_label, title_label,
)
from starwright.operators.defaults import apply_defaults
from starwright.operators.filters import cols_with_prefix, project


def test_text_functions(spark):
    df = spark.createDataFrame([(None, "Lee", 3, None, None), ("Ann", None, None, "Jo", "Li")],
                               "first string, last string, sid int, mf string, ml string")
    rows = df.select(full_name("first", "last").alias("n"), store_label("sid", "mf", "ml").alias("s")).collect()
    assert [(r.n, r.s) for r in rows] == [("Lee", "Store 3 ( )"), ("Ann", None)]
    for name, label in (("film_in_category_scifi", "Scifi"), ("SCIFI", "Scifi"), ("FILM_IN_CATEGORY_NEW AGE", "New Age"),
                        ("film_in_category_80s", "80s"), ("x_film_in_category_a", "X_film_in_category_a")):
        assert title_label(name, "film_in_category_") == label
    assert spark.range(1).select(money_text(F.lit(1234.5)).alias("m")).first().m == "$1,234.50"


def test_date_functions(spark):
    df = spark.createDataFrame([(dt.datetime(2005, 1, 1, 23, 59),), (dt.datetime(2006, 1, 2, 0, 0),)], "ts timestamp_ntz")
    rows = df.select(
        epoch_seconds(F.to_date("ts")).alias("e"), iso_week(F.to_date("ts")).alias("w"),
        month_start("ts").alias("m"), date_key(F.col("ts"), "2005-01-01", "2005-12-31").alias("k")).collect()
    assert [(r.e, r.w, r.m, r.k) for r in rows] == [
        (1104537600, "53", dt.date(2005, 1, 1), 0), (1136160000, "01", dt.date(2006, 1, 1), None)]
    cols = calendar_columns(F.to_date(F.lit("2005-01-02")))
    r = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    assert (r.weekend, r.day_of_week, r.month, r.month_day, r.year) == ("Weekend", "Sunday", "January", 2, 2005)


def test_flags_and_money(spark):
    df = spark.createDataFrame([("1", 0.1, 0), ("true", 0.2, 2), ("0", None, None), ("NULL", 0.7, 1)],
                               "flag string, amount double, n int")
    rows = df.select(is_truthy("flag").alias("t"), null_if_tokens("flag", ["NULL"]).alias("f"),
                     safe_div(F.lit(1.0), "n").alias("d")).collect()
    assert [r.t for r in rows] == [True, True, False, False]
    assert [r.f for r in rows] == ["1", "true", "0", None]
    assert [r.d for r in rows] == [None, 0.5, None, 1.0]
    # 0.1 + 0.2 + 0.7 in cents is exactly 1.0
    assert df.agg(money_sum("amount").alias("s")).first().s == 1.0
    assert df.where("amount IS NULL").agg(money_sum("amount").alias("s")).first().s is None


def test_projection_helpers_and_timestamp_default(spark):
    df = spark.createDataFrame([(1, "a", None)], "film_id int, FILM_IN_CATEGORY_x string, last_update timestamp_ntz")
    assert cols_with_prefix(df, "film_in_category_") == ["FILM_IN_CATEGORY_x"]
    assert project(df, {"film_id": "id"}).columns == ["id"]
    out = apply_defaults(df, {"last_update": "CURRENT_TIMESTAMP"})
    assert out.schema["last_update"].dataType.typeName() == "timestamp_ntz"
    assert out.first().last_update is not None


def test_utf8_repair(spark):
    from starwright.functions import is_utf8, repair_utf8
    df = spark.createDataFrame([(bytearray(b"ab\xff\xfecd"),), (bytearray("ok é".encode()),)], "raw binary")
    rows = df.select(is_utf8("raw").alias("ok"), repair_utf8("raw").alias("fixed")).collect()
    assert [r.ok for r in rows] == [False, True]
    assert rows[0].fixed.startswith("ab") and rows[0].fixed.endswith("cd") and "�" in rows[0].fixed
    assert rows[1].fixed == "ok é"
