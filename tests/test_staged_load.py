import os

from pyspark.sql import types as T

from starwright.streaming.staged_load import run_staged_load

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])


def _put(stage, name, body: bytes):
    with open(os.path.join(stage, name), "wb") as f:
        f.write(body)


def test_each_staged_file_loads_once(spark, tmp_dir):
    stage, table, rejects, ckpt = (os.path.join(tmp_dir, d) for d in ("stage", "table", "rejects", "ckpt"))
    os.makedirs(stage)
    _put(stage, "a.csv", b"id,name\n1,Ann\n2,NULL\nx,Bad\n")
    _put(stage, "b.csv", b"id,name\n3,Cy\n")
    run_staged_load(spark, stage, SCHEMA, table, rejects, "utf8", checkpoint_location=ckpt)
    assert sorted((r.id, r.name) for r in spark.read.parquet(table).collect()) == [(1, "Ann"), (2, None), (3, "Cy")]
    rej = spark.read.parquet(rejects).collect()
    assert [(r.file_name, r.column_name, r.raw_value) for r in rej] == [("a.csv", "id", "x")]
    # a second run sees only the new file; old files are not loaded again
    _put(stage, "c.csv", b"id,name\n4,Dee\n")
    run_staged_load(spark, stage, SCHEMA, table, rejects, "utf8", checkpoint_location=ckpt)
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3, 4]
    # nothing new: a third run adds nothing
    run_staged_load(spark, stage, SCHEMA, table, rejects, "utf8", checkpoint_location=ckpt)
    assert spark.read.parquet(table).count() == 4


_SESSION = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import types as T
from starwright.session import get_session
from starwright.streaming.staged_load import run_staged_load
spark = get_session("local[2]", conf={"spark.checkpoint.dir": sys.argv[5], "spark.sql.shuffle.partitions": "2"})
schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
run_staged_load(spark, sys.argv[2], schema, sys.argv[3], sys.argv[4])
"""


def test_exactly_once_across_sessions(spark, tmp_dir):
    """Two processes with the default location: the second loads what is new."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    stage, table, rejects, ckpt = (os.path.join(tmp_dir, d) for d in ("stage", "table", "rejects", "ckpt"))
    os.makedirs(stage)
    _put(stage, "a.csv", b"id,name\n1,Ann\n2,Bo\n")
    _put(stage, "b.csv", b"id,name\n3,Cy\n")
    run = lambda: subprocess.run([sys.executable, "-c", _SESSION, root, stage, table, rejects, ckpt], check=True,
                                 capture_output=True, timeout=240)
    run()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3]
    _put(stage, "c.csv", b"id,name\n4,Dee\n")
    run()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3, 4]


def test_one_file_per_batch(spark, tmp_dir):
    stage, table, rejects, ckpt = (os.path.join(tmp_dir, d) for d in ("stage", "table", "rejects", "ckpt"))
    os.makedirs(stage)
    for i in range(3):
        _put(stage, f"f{i}.csv", b"id,name\n%d,n%d\n" % (i, i))
    run_staged_load(spark, stage, SCHEMA, table, rejects, "utf8", checkpoint_location=ckpt, max_files_per_trigger=1)
    batches = sorted(d for d in os.listdir(table) if d.startswith("batch_id="))
    assert batches == ["batch_id=0", "batch_id=1", "batch_id=2"]
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [0, 1, 2]
