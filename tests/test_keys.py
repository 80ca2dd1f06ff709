import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starwright.operators.keys import assign_key


@pytest.mark.parametrize("partitions", ["1", "6", "40"])
def test_assign_key_equals_row_number(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    src = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("nat"), F.lit("x").alias("payload"))
    keyed = assign_key(src, "k", "nat", start=1)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = src.select((F.row_number().over(Window.orderBy("nat"))).cast("long").alias("k"), "nat")
    assert keyed.select("k", "nat").exceptAll(expected).count() == 0
    assert keyed.count() == 5000
    assert keyed.select("k").distinct().count() == 5000
    assert keyed.agg(F.min("k"), F.max("k")).first() == (1, 5000)


def test_assign_key_start_value(spark):
    src = spark.createDataFrame([(30,), (10,), (20,)], ["country_id"])
    rows = assign_key(src, "key", "country_id", start=110).orderBy("key").collect()
    assert [(r.key, r.country_id) for r in rows] == [(110, 10), (111, 20), (112, 30)]


def test_assign_key_stable_across_actions(spark):
    """Distributed keys are pinned: two actions see the same numbering."""
    src = spark.range(0, 2000).select(((F.col("id") * 13) % 2003).alias("nat"))
    keyed = assign_key(src, "k", "nat")
    a = {r.nat: r.k for r in keyed.collect()}
    b = {r.nat: r.k for r in keyed.collect()}
    assert a == b


def test_assign_key_empty(spark):
    src = spark.range(0).select(F.col("id").alias("nat"))
    assert assign_key(src, "k", "nat").count() == 0
