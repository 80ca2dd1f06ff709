"""Keys over several loads, appended loads and published tables: repeated,
failed and cut-off runs."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.operators.stable_keys import KeyStore, KeyTable
from starwright.sources.publish import Folder, publish, read_published
from starwright.sources.sinks import append_load, read_loads, write_table


def ids(spark, values):
    return spark.createDataFrame([(v, "row") for v in values], "id long, note string")


def known(keys):
    return {r["id"]: r["k"] for r in keys.known().collect()}


def failing(spark, rows=50):
    """A table whose last rows cannot be computed."""
    return spark.range(0, rows, 1, 5).select(
        "id", F.when(F.col("id") < rows - 1, F.lit("x")).otherwise(F.raise_error(F.lit("broken source"))).alias("note"))


def test_keys_stay_over_loads(spark, tmp_dir):
    keys = KeyTable(spark, f"{tmp_dir}/k", "id", "k", start=110)
    assert keys.known() is None
    keys.extend(ids(spark, [30, 10, 20]))
    first = known(keys)
    assert first == {10: 110, 20: 111, 30: 112}
    keys.extend(ids(spark, [5, 20, 40, 10, 40]))  # 30 is gone, 5 comes before all
    second = known(keys)
    assert second == first | {5: 113, 40: 114}
    keys.extend(ids(spark, [30, 5]))  # nothing new; 30 returns with its key
    assert known(keys) == second
    assert sorted(r["key_load"] for r in keys.known().collect()) == [1, 1, 1, 2, 2]


def test_hot_and_null_ids(spark, tmp_dir):
    keys = KeyTable(spark, f"{tmp_dir}/k", ["a", "b"], "k")
    df = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 500).cast("long").alias("a"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 2, None).otherwise("x").alias("b"), F.col("id").alias("row"))
    keys.extend(df)
    keys.extend(df)
    table = keys.known()
    n = df.where("a is not null and b is not null").select("a", "b").distinct().count()
    assert table.count() == n and table.agg(F.min("k"), F.max("k"), F.count_distinct("k")).first() == (1, n, n)
    out = keys.attach(df)
    assert out.columns == ["k", "a", "b", "row"] and out.count() == 30_000
    assert out.where("(a is null or b is null) <> (k is null)").count() == 0
    assert out.where("b = 'hot'").select("k").distinct().count() == 1


def test_a_load_that_fails_gives_no_keys(spark, tmp_dir):
    keys = KeyTable(spark, f"{tmp_dir}/k", "id", "k")
    keys.extend(ids(spark, [1, 2]))
    broken = failing(spark).where(F.length("note") > 0)
    with pytest.raises(Exception, match="broken source"):
        keys.extend(broken)
    assert known(keys) == {1: 1, 2: 2} and keys.loads() == [1]
    keys.extend(ids(spark, [3]))
    assert known(keys) == {1: 1, 2: 2, 3: 3}


def test_empty_loads_and_other_types(spark, tmp_dir):
    keys = KeyTable(spark, f"{tmp_dir}/k", "id", "k", start=5)
    assert keys.attach(ids(spark, [1])).first()["k"] is None
    keys.extend(ids(spark, []))
    keys.extend(ids(spark, [9]).withColumn("id", F.col("id").cast("int")))
    keys.extend(ids(spark, []))
    assert known(keys) == {9: 5}


def test_two_writers_do_not_share_keys(spark, tmp_dir):
    publish(ids(spark, [1]), f"{tmp_dir}/k/key_load=1", replace=False)
    with pytest.raises(FileExistsError):
        publish(ids(spark, [2]), f"{tmp_dir}/k/key_load=1", replace=False)
    assert spark.read.parquet(f"{tmp_dir}/k").count() == 1


def test_failed_write_leaves_the_old_rows(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    write_table(ids(spark, [1, 2]), path)
    with pytest.raises(Exception, match="broken source"):
        write_table(failing(spark), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]
    with pytest.raises(Exception):  # a value that does not fit its declared type
        write_table(spark.createDataFrame([("x",)], "id string"), path, T.StructType([T.StructField("id", T.IntegerType())]))
    assert sorted(r["id"] for r in read_published(spark, path).collect()) == [1, 2]
    assert os.listdir(tmp_dir) == ["t"]  # nothing is left beside it


def test_a_table_replaced_by_its_own_rows(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    write_table(ids(spark, range(100)), path)
    write_table(spark.read.parquet(path).where("id % 2 = 0"), path, partition_by=["note"])
    assert spark.read.parquet(path).count() == 50


@pytest.mark.parametrize("cut", ["old aside", "new in place", "writing"])
def test_switches_that_were_cut_off(spark, tmp_dir, cut):
    path = f"{tmp_dir}/t"
    write_table(ids(spark, [1]), path)
    folder = Folder(spark, path)
    new = folder.new()
    ids(spark, [2, 3]).write.parquet(new.toString())
    if cut != "writing":
        folder._rename(folder.path, folder.old)
    if cut == "new in place":
        folder._rename(new, folder.path)
    rows = sorted(r["id"] for r in read_published(spark, path).collect())
    assert rows == ([2, 3] if cut == "new in place" else [1])
    write_table(ids(spark, [4]), path)
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [4] and os.listdir(tmp_dir) == ["t"]


def test_loads_count_once(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    cols = ["id", "note"]
    append_load(ids(spark, [1, 2]), path, cols, "007")
    append_load(ids(spark, [3]).select("note", "id"), path, cols, 8)  # by name
    for _ in range(2):
        append_load(ids(spark, [1, 2]), path, cols, "007")  # run again
    table = lambda: sorted((r["id"], r["load_id"]) for r in read_loads(spark, path).collect())
    assert table() == [(1, "007"), (2, "007"), (3, "8")]
    with pytest.raises(Exception, match="broken source"):
        append_load(failing(spark), path, cols, "9")
    assert table() == [(1, "007"), (2, "007"), (3, "8")]
    append_load(ids(spark, [9]), path, cols, "9")  # the failed one again
    append_load(ids(spark, []), path, cols, "007")  # corrected to nothing
    assert table() == [(3, "8"), (9, "9")]


def test_loads_that_do_not_fit(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    append_load(ids(spark, [1]), path, ["id", "note"], 1)
    with pytest.raises(ValueError, match="differ"):
        append_load(ids(spark, [1]).withColumn("id", F.col("id").cast("string")), path, ["id", "note"], 2)
    with pytest.raises(ValueError, match="differ"):
        append_load(ids(spark, [1]), path, ["id"], 2)
    for bad in ("", "a/b", "x=1", "_x", "a b"):
        with pytest.raises(ValueError):
            append_load(ids(spark, [1]), path, ["id"], bad)
    with pytest.raises(FileNotFoundError):
        read_loads(spark, f"{tmp_dir}/none")
    assert read_loads(spark, path).count() == 1


def test_second_build_of_the_warehouse_keeps_keys(spark, tmp_dir):
    """The sources lose, change and gain rows between two builds."""
    from test_warehouse import _write_reference_tables

    from starwright.plans.warehouse import build_warehouse, check_warehouse
    from starwright.sources.rental_tables import RentalTables
    from starwright.sources.tables import TableSource

    src, out = f"{tmp_dir}/src", f"{tmp_dir}/dw"
    os.makedirs(src)
    _write_reference_tables(spark, src)
    keys = KeyStore(spark, f"{tmp_dir}/keys")
    build = lambda: build_warehouse(spark, RentalTables(TableSource(spark, src)), out, ("2005-01-01", "2017-01-01"), keys=keys)
    dims = {"dim_actor": ("actor_id", "actor_key"), "dim_customer": ("customer_id", "customer_key"),
            "dim_film": ("film_id", "film_key"), "dim_location_country": ("location_country_id", "location_country_key")}
    read = lambda wh: {n: {r[0]: r[1] for r in wh.read(n).select(*c).collect()} for n, c in dims.items()}
    first = read(build())
    actors = spark.read.parquet(f"{src}/actor.parquet")
    low, high = actors.agg(F.min("actor_id"), F.max("actor_id")).first()
    changed = actors.where(F.col("actor_id") != high).unionByName(
        actors.where(F.col("actor_id") == low).withColumn("actor_id", F.lit(-5).cast("long")))
    changed.write.mode("overwrite").parquet(f"{tmp_dir}/actors-changed")
    spark.read.parquet(f"{tmp_dir}/actors-changed").write.mode("overwrite").parquet(f"{src}/actor.parquet")
    wh = build()
    second = read(wh)
    assert second["dim_actor"] == {low: first["dim_actor"][low], -5: max(first["dim_actor"].values()) + 1}
    assert {n: k for n, k in second.items() if n != "dim_actor"} == {n: k for n, k in first.items() if n != "dim_actor"}
    third = read(build())
    assert third == second
    report = {(r.table_name, r.check): r.violations for r in check_warehouse(wh).collect() if r.check == "primary_key"}
    assert report[("dim_actor", "primary_key")] == 0
