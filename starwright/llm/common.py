"""Helpers shared by the operators: tables, scratch tables, ordered buckets."""

from __future__ import annotations

import bisect
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.session import ensure_checkpoint_dir

# Rows and bytes handed to a Python task at a time: bounds its memory
# whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batch_limits(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_limits(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_text(col: str | Column) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def unused(name: str, df: DataFrame) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables of one operator run in the shared folder ``spark.checkpoint.dir``.

    A written table cuts lineage: whatever is computed from it survives the
    loss of executors, and work in Python is not done twice.  ``drop`` removes
    tables that later tables no longer need.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_cuts(df: DataFrame, key: str, buckets: int) -> list:
    """At most ``buckets - 1`` ascending keys that cut the rows into ranges of
    about equal size.  The driver gets these keys only."""
    if buckets < 2:
        return []
    cuts = df.where(F.col(key).isNotNull()).approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    return sorted({int(c) for c in cuts})


def bucket_of(key: Column, cuts: list) -> Column:
    """Number of the range that a key falls in: how many cuts are <= key."""
    if not cuts:
        return F.lit(0)
    if len(cuts) <= 8:
        return sum((key >= F.lit(c)).cast("int") for c in cuts)
    mid = len(cuts) // 2  # a balanced tree of comparisons
    return F.when(key < F.lit(cuts[mid]), bucket_of(key, cuts[:mid])).otherwise(
        bucket_of(key, cuts[mid + 1:]) + F.lit(mid + 1))


def bucket_index(value, cuts: list) -> int:
    return bisect.bisect_right(cuts, value)
