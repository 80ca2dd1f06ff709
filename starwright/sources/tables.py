"""Reading source and warehouse tables."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


class TableSource:
    """Named Parquet tables under one root folder (``{root}/{name}.parquet``).

    In production the same interface can sit on a catalog
    (``spark.table``) or a JDBC source read with ``partitionColumn`` so
    the read is split across executors."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The table (listed and its footer read once per source object, until
        :meth:`refresh`), optionally projected; pruning reaches the Parquet
        scan."""
        df = self._frames.get(name)
        if df is None:
            df = self._frames[name] = self.spark.read.parquet(self.path(name))
        return df.select(*columns) if columns else df

    def refresh(self) -> None:
        """List tables anew from now on, e.g. after they were rewritten."""
        self._frames.clear()

    def __call__(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        return self.read(name, columns)

    def exists(self, name: str) -> bool:
        return os.path.exists(self.path(name)) if "://" not in self.root else True

    def register_views(self, names: Iterable[str]) -> None:
        """Expose tables as temporary views for ``spark.sql``."""
        for name in names:
            self.read(name).createOrReplaceTempView(name)


def table(spark: SparkSession, database: str | None, schema: str | None, name: str) -> DataFrame:
    """Read a table by (catalog-or-database, schema, name), like a three-part
    name; parts given as None are left out."""
    parts = [p for p in (database, schema, name) if p]
    return spark.table(".".join(parts))
