import os

import pytest

from pyspark.sql import types as T

from starwright.schemas import DIM_COUNTRY
from starwright.sources.sinks import append_table, conform, write_table
from starwright.sources.tables import TableSource, table


def test_write_table_conforms_to_schema(spark, tmp_dir):
    df = spark.createDataFrame([(110, 1, "Chile")], "location_country_key int, location_country_id int, "
                               "location_country_name string")
    path = os.path.join(tmp_dir, "dim_location_country")
    write_table(df, path, DIM_COUNTRY.schema)
    back = spark.read.parquet(path)
    assert back.columns == [f.name for f in DIM_COUNTRY.schema.fields]
    assert back.schema["location_country_key"].dataType == T.LongType()
    assert back.first().location_country_last_update is None


def test_append_binds_by_name(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    spark.createDataFrame([(1, "a")], "id int, name string").write.parquet(path)
    # columns in another order: appended by name, never by position
    append_table(spark.createDataFrame([("b", 2)], "name string, id int"), path, ["id", "name"])
    assert sorted((r.id, r.name) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def test_conform_adds_missing_columns(spark):
    out = conform(spark.createDataFrame([(1,)], "a int"), T.StructType([T.StructField("a", T.LongType()),
                                                                        T.StructField("b", T.StringType())]))
    assert out.first() == (1, None)


def test_table_sources_and_three_part_names(spark, tmp_dir):
    spark.createDataFrame([(1,)], "x int").write.parquet(os.path.join(tmp_dir, "t1.parquet"))
    src = TableSource(spark, tmp_dir)
    assert src("t1", ["x"]).count() == 1 and src.exists("t1")
    src.register_views(["t1"])
    assert table(spark, None, None, "t1").count() == 1
    spark.createDataFrame([(2,), (3,)], "x int").createOrReplaceGlobalTempView("t2")
    assert table(spark, None, "global_temp", "t2").count() == 2


def test_checkpoint_dir_guard():
    """A configured folder is used as is; where it is unset, the folder lies
    below the shared warehouse."""
    from starwright.session import ensure_checkpoint_dir

    class Conf:
        def __init__(self, d):
            self.d = d

        def get(self, k, default=None):
            return self.d.get(k, default)

    class SC:
        def __init__(self, master, conf):
            self.master, self._conf, self.dir = master, Conf(conf), None

        def getCheckpointDir(self):
            return self.dir

        def getConf(self):
            return self._conf

        def setCheckpointDir(self, d):
            self.dir = d

    class S:
        def __init__(self, sc, warehouse="hdfs:///warehouse"):
            self.sparkContext, self.conf = sc, Conf({"spark.sql.warehouse.dir": warehouse})

    assert ensure_checkpoint_dir(S(SC("yarn", {}))) == "hdfs:///warehouse/_checkpoints"
    assert ensure_checkpoint_dir(S(SC("yarn", {"spark.checkpoint.dir": "hdfs:///ckpt"}))) == "hdfs:///ckpt"
    # On a cluster, the driver's own disk is refused; in local mode it is shared.
    for own in ("file:/tmp/spark-warehouse", "/tmp/spark-warehouse"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(S(SC("yarn", {}), own))
        assert ensure_checkpoint_dir(S(SC("yarn", {"spark.checkpoint.dir": "hdfs:///c"}), own)) == "hdfs:///c"
        assert ensure_checkpoint_dir(S(SC("local[4]", {}), own)) == f"{own}/_checkpoints"
