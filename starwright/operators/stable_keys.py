"""Surrogate keys that later loads keep.

A key table holds, per load, the ids first met in it and their keys.  A load
numbers only ids that are not in the table, from the largest key on, so keys are
dense, never change and are never given again, also when an id goes and returns.

Only ids move: they are made distinct before they are compared (a hot id is one
row per task), and the new ones are numbered without passing one task
(:func:`starwright.operators.keys.assign_key`).  A load's keys become visible all
at once; a load that failed left none, and one that is repeated finds no new ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.operators.keys import assign_key
from starwright.sources.publish import Folder, publish

_LOAD = "key_load"


class KeyTable:
    """Keys of one kind of thing, told apart by ``id_cols``, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, id_cols: str | Sequence[str], key: str, start: int = 1):
        self.spark, self.path, self.key, self.start = spark, path.rstrip("/"), key, start
        self.id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)

    def loads(self) -> list[int]:
        prefix = f"{_LOAD}="
        return sorted(int(n[len(prefix):]) for n in Folder(self.spark, self.path).children() if n.startswith(prefix))

    def known(self) -> DataFrame | None:
        """(id columns, key, key_load) of all loads; None before the first."""
        return self.spark.read.parquet(self.path) if self.loads() else None

    def extend(self, df: DataFrame) -> DataFrame:
        """Give keys to the ids of ``df`` that have none; returns all known
        (id columns, key, key_load).  Ids with a null in them get no key: they
        could not be recognised by a later load."""
        loads, known = self.loads(), self.known()
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.id_cols])
        ids = df.select(*self.id_cols).where(complete).distinct()
        start = self.start
        if known is not None:
            ids = ids.select(*[F.col(c).cast(known.schema[c].dataType).alias(c) for c in self.id_cols])
            ids = ids.join(known.select(*self.id_cols), self.id_cols, "left_anti")
            top = known.agg(F.max(self.key)).first()[0]  # one value
            start = self.start if top is None else top + 1
        publish(assign_key(ids, self.key, self.id_cols, start).select(*self.id_cols, self.key),
                f"{self.path}/{_LOAD}={loads[-1] + 1 if loads else 1}", replace=False)
        return self.known()

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the key in front; rows whose id has no key have a null
        one.  The table has each id once, so rows neither go nor double, and a
        hot id is on the side of the join that can be split."""
        known = self.known()
        if known is None:
            return df.select(F.lit(None).cast("long").alias(self.key), "*")
        return df.join(known.select(*self.id_cols, self.key), self.id_cols, "left").select(self.key, *df.columns)


class KeyStore:
    """Key tables of a warehouse, one per key name, under one folder.
    :meth:`assign` numbers like ``assign_key`` on the first load and keeps those
    keys on later ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, key: str, id_cols: str | Sequence[str], start: int = 1) -> KeyTable:
        return KeyTable(self.spark, f"{self.root}/{key}", id_cols, key, start)

    def assign(self, df: DataFrame, key: str, order_by: str | Sequence[str], start: int = 1) -> DataFrame:
        keys = self.table(key, order_by, start)
        keys.extend(df)
        return keys.attach(df)
