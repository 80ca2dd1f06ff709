import datetime as dt

from starwright.operators.calendar import date_dim, numbers, numbers_small
from starwright.schemas import REFERENCE_CALENDAR


def test_numbers_is_0_to_9999(spark):
    df = numbers(spark)
    row = df.agg({"number": "min"}).first()[0], df.agg({"number": "max"}).first()[0], df.count()
    assert row == (0, 9999, 10000)
    assert df.distinct().count() == 10000
    assert sorted(r.number for r in numbers_small(spark).collect()) == list(range(10))


def test_numbers_cross_join_equivalence(spark):
    """The digit cross join of the reference gives the same set as range."""
    digits = numbers_small(spark)
    t, h, te, o = (digits.alias(a) for a in "thio")
    crossed = t.crossJoin(h).crossJoin(te).crossJoin(o).selectExpr(
        "t.number * 1000 + h.number * 100 + i.number * 10 + o.number AS number")
    assert crossed.exceptAll(numbers(spark).selectExpr("CAST(number AS INT) AS number")).count() == 0
    assert crossed.count() == 10000


def test_reference_calendar(spark):
    cal = date_dim(spark, *REFERENCE_CALENDAR)
    assert cal.count() == 4384
    keys = cal.agg({"date_key": "min"}).first()[0], cal.agg({"date_key": "max"}).first()[0]
    assert keys == (0, 4383)
    rows = {r["date"]: r for r in cal.where("date_key IN (0, 366, 4383)").collect()}
    first = rows[dt.date(2005, 1, 1)]
    assert (first.date_key, first.day_of_week, first.weekend, first.week_starting_monday) == (0, "Saturday", "Weekend", "53")
    assert first.timestamp == 1104537600
    assert (first.month, first.month_day, first.year) == ("January", 1, 2005)
    monday = rows[dt.date(2006, 1, 2)]
    assert (monday.day_of_week, monday.weekend, monday.week_starting_monday) == ("Monday", "Weekday", "01")
    assert rows[dt.date(2017, 1, 1)].date_key == 4383


def test_calendar_unique_dates(spark):
    cal = date_dim(spark, "2016-02-27", "2016-03-01")
    assert [r["date"].isoformat() for r in cal.orderBy("date_key").collect()] == [
        "2016-02-27", "2016-02-28", "2016-02-29", "2016-03-01"]
