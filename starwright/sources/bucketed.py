"""Tables laid out by hash buckets of an id, so that lookups by it move no rows.

A table stored in as many buckets as the table it is looked up in meets it
bucket by bucket: the shuffle is paid once, when the table is written, and no
lookup moves its rows again.  A bucket is one task's work, though, and no shuffle
is left that adaptive execution could split.  So the rows of hot ids (more than an
even bucket's share, which fewer ids than buckets can have) and those without an
id are stored beside the buckets.  They meet the rows of those few ids by broadcast,
which is bounded by the number of buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LAYOUT = T.StructType([T.StructField("on", T.StringType()), T.StructField("buckets", T.IntegerType())])


@dataclass(frozen=True)
class Bucketed:
    """A stored table: rows in buckets of ``on``, rows beside them, hot ids."""

    on: str
    buckets: int
    even: DataFrame
    beside: DataFrame
    hot: DataFrame

    def rows(self) -> DataFrame:
        return self.even.unionByName(self.beside)


def hot_ids(df: DataFrame, on: str, buckets: int) -> DataFrame:
    """Ids with more rows than an even bucket has: fewer than ``buckets`` of
    them, whatever the rows."""
    known = df.where(F.col(on).isNotNull())
    even = known.count() / buckets
    return known.groupBy(on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > even).select(on)


def write_bucketed(df: DataFrame, path: str, on: str, buckets: int, unique: bool = False) -> Bucketed:
    """Store ``df`` below ``path`` by buckets of ``on``.  ``unique``: no id
    repeats (a dimension), so no id can be hot.  An earlier table there is not
    replaced; the write then fails."""
    spark, path = df.sparkSession, path.rstrip("/")
    none = df.select(on).limit(0)
    (none if unique else hot_ids(df, on, buckets)).write.parquet(f"{path}/hot")
    # Fewer rows than buckets by construction, and read back from storage.
    hot = spark.read.schema(none.schema).parquet(f"{path}/hot")
    marked = df.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")
    apart = F.col("__hot").isNotNull() | F.col(on).isNull()
    marked.where(apart).select(*df.columns).write.parquet(f"{path}/beside")
    # Rows are brought together by the hash that the buckets use: one file each.
    (marked.where(~apart).select(*df.columns).repartition(buckets, on).write.format("parquet")
     .bucketBy(buckets, on).sortBy(on).option("path", f"{path}/even").saveAsTable(_name(path)))
    spark.createDataFrame([(on, buckets)], _LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
    return read_bucketed(spark, path)


def read_bucketed(spark: SparkSession, path: str) -> Bucketed:
    """A stored table, also one that another session wrote."""
    path = path.rstrip("/")
    on, buckets = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
    name = _name(path)
    schema = spark.read.parquet(f"{path}/beside").schema
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet "
                  f"CLUSTERED BY (`{on}`) SORTED BY (`{on}`) INTO {buckets} BUCKETS LOCATION '{path}/even'")
    return Bucketed(on, buckets, spark.table(name), spark.read.schema(schema).parquet(f"{path}/beside"),
                    spark.read.schema(T.StructType([schema[on]])).parquet(f"{path}/hot"))


def _name(path: str) -> str:
    return "bucketed_" + hashlib.md5(path.encode()).hexdigest()


def lookup_bucketed(lines: Bucketed, dim: Bucketed, take: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of ``lines`` with columns of the dimension row of their id; ``how`` is
    ``inner`` or ``left``.  Both are stored in the same number of buckets, and an
    id is in the dimension once.  Rows of ``lines`` are not moved."""
    if lines.buckets != dim.buckets:
        raise ValueError(f"{lines.buckets} buckets cannot meet {dim.buckets}")
    if how not in ("inner", "left"):
        raise ValueError(f"a lookup is inner or left, not {how}")
    taken = [take] if isinstance(take, str) else list(take)

    def meet(rows: DataFrame, keys: DataFrame) -> DataFrame:
        right = keys.select(F.col(dim.on).alias("__id"), *taken)
        return rows.join(right, F.col(lines.on) == F.col("__id"), how).drop("__id")

    of_hot = dim.rows().join(F.broadcast(lines.hot.withColumnRenamed(lines.on, "__hot")),
                             F.col(dim.on) == F.col("__hot"), "left_semi")
    return meet(lines.even, dim.even).unionByName(meet(lines.beside, F.broadcast(of_hot)))
