"""Catalogue tables that enforce what they declare."""

import uuid

import pytest
from pyspark.sql import functions as F

from starwright.schemas import DATE_DEFAULTS, WAREHOUSE
from starwright.sources.declared import create_table, create_warehouse, insert_rows
from starwright.sources.tables import table

ACTOR = "actor_key long, actor_id long, actor_last_name string, actor_first_name string"


@pytest.fixture()
def database(spark):
    name = f"dw_{uuid.uuid4().hex[:8]}"
    create_warehouse(spark, name)
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_every_table_is_declared(spark, database):
    assert {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database}").collect()} == set(WAREHOUSE)
    for name, spec in WAREHOUSE.items():
        assert table(spark, None, database, name).columns == [f.name for f in spec.schema.fields]
    kinds = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE {database}.dim_location_address").collect()}
    assert kinds["location_address"] == "varchar(64)" and kinds["location_address_postal_code"] == "varchar(10)"
    assert {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE {database}.dim_film").collect()}[
        "film_rental_rate"] == "decimal(4,2)"
    create_warehouse(spark, database)  # existing tables stay


def test_omitted_columns_get_their_default(spark, database):
    insert_rows(spark.createDataFrame([(0, "2005-01-01")], "date_key long, day string").select(
        "date_key", F.to_date("day").alias("date")), f"{database}.dim_date")
    assert spark.table(f"{database}.dim_date").first()["weekend"] == DATE_DEFAULTS["weekend"]
    insert_rows(spark.createDataFrame([("Berg", 1, "Anna", 7)], "actor_last_name string, actor_key long, actor_first_name string, "
                                      "actor_id long"), f"{database}.dim_actor")
    row = spark.table(f"{database}.dim_actor").first()
    assert (row["actor_key"], row["actor_id"], row["actor_last_name"]) == (1, 7, "Berg") and row["actor_last_update"] is not None


def test_what_does_not_fit_fails_the_write(spark, database):
    name = f"{database}.dim_actor"
    rows = lambda *r: spark.createDataFrame(list(r), ACTOR)
    insert_rows(rows((1, 1, "x" * 45, "A")), name)
    for bad, said in (((2, 2, "x" * 46, "A"), "EXCEED_LIMIT_LENGTH"), ((2, 2, None, "A"), "NULL in")):
        with pytest.raises(Exception, match=said):
            insert_rows(rows((5, 5, "fits", "A"), bad).repartition(2), name)
    with pytest.raises(Exception, match="CANNOT_SAFELY_CAST"):
        insert_rows(rows((3, 3, "a", "b")).withColumn("actor_key", F.lit("three")), name)
    with pytest.raises(ValueError, match="needs"):
        insert_rows(rows((4, 4, "a", "b")), name, ["actor_key", "actor_id"])
    with pytest.raises(ValueError, match="no columns"):
        insert_rows(rows((4, 4, "a", "b")).withColumn("more", F.lit(1)), name)
    film = f"{database}.dim_film"
    money = spark.createDataFrame([(1, "123.45")], "film_key long, rate string").select(
        "film_key", F.col("rate").cast("decimal(5,2)").alias("film_rental_rate"))
    with pytest.raises(Exception):
        insert_rows(money, film)
    assert [tuple(r)[0] for r in spark.table(name).collect()] == [1] and spark.table(film).count() == 0


def test_own_defaults(spark, database):
    name = create_table(spark, WAREHOUSE["dim_location_country"], f"{database}.own", {"location_country_name": "it's \\ here"})
    spec = WAREHOUSE["dim_location_country"]
    insert_rows(spark.createDataFrame([(110, 1)], "location_country_key long, location_country_id long"), name, spec=spec)
    assert spark.table(name).first()["location_country_name"] == "it's \\ here"
