from starwright.operators import quality
from starwright.operators.aggregates import row_counts
from starwright.operators.defaults import apply_defaults, fill


def test_check_unique(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (2, 1), (2, 1)], "a int, b int")
    got = sorted((r.a, r.b, r.copies) for r in quality.check_unique(df, ["a", "b"]).collect())
    assert got == [(1, 1, 2), (2, 1, 3)]


def test_check_orphans_null_exempt(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 12)], "id int, parent int")
    parent = spark.createDataFrame([(10,), (10,), (12,)], "pid int")
    got = [r.id for r in quality.check_orphans(child, parent, "parent", "pid").collect()]
    assert got == [2]


def test_check_not_null(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {r.column_name: r.nulls for r in quality.check_not_null(df).collect()} == {"a": 1, "b": 2}


def test_check_domain(spark):
    df = spark.createDataFrame([(1, 12.34, "abc"), (2, 12.345, "abcdef"), (3, 1000.0, None), (4, None, "ab")],
                               "id int, v double, s string")
    got = sorted((r.id, r.column_name, r.reason)
                 for r in quality.check_domain(df, "id", lengths={"s": 5}, decimals={"v": (5, 2)}).collect())
    # 12.345 would be rounded silently by a cast; 1000.00 needs 6 digits
    assert got == [(2, "s", "too_long"), (2, "v", "scale"), (3, "v", "overflow")]


def test_row_counts(spark):
    counts = row_counts({"b": spark.range(3), "a": spark.range(5)})
    assert [(r.table_name, r.row_count) for r in counts.collect()] == [("a", 5), ("b", 3)]


def test_defaults_and_fill(spark):
    df = spark.createDataFrame([(None, None), (2.5, 1)], "dollar_amount double, count_returns int")
    out = apply_defaults(df, {"dollar_amount": 0.0, "count_returns": 0, "count_rentals": 1, "weekend": "Weekday"})
    rows = sorted((r.dollar_amount, r.count_returns, r.count_rentals, r.weekend) for r in out.collect())
    assert rows == [(0.0, 0, 1, "Weekday"), (2.5, 1, 1, "Weekday")]
    f = fill(spark.createDataFrame([(None, None)], "a string, b double")).first()
    assert (f.a, f.b) == ("", 0.0)


def test_orphan_counts_one_pass(spark):
    child = spark.createDataFrame([(1, 10, 1), (2, 11, None), (3, None, 7), (4, 12, 7)], "id int, a int, b int")
    a = spark.createDataFrame([(10,), (10,), (12,), (None,)], "pid int")
    b = spark.createDataFrame([(1,)], "key int")
    got = {r.column_name: r.violations for r in quality.orphan_counts(child, {"a": (a, "pid"), "b": (b, "key")}).collect()}
    assert got == {"a": 1, "b": 2}


def test_violation_counts_one_pass(spark):
    df = spark.createDataFrame([(1, 12.34, "abc"), (None, 12.345, "abcdef"), (3, 1000.0, None)],
                               "id int, v double, s string")
    got = {(r.check, r.column_name): r.violations
           for r in quality.violation_counts(df, ["id", "s"], {"s": 5}, {"v": (5, 2)}).collect()}
    assert got == {("not_null", "id"): 1, ("not_null", "s"): 1, ("domain", "s"): 1, ("domain", "v"): 2}
