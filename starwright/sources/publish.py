"""Replace a table of files as a whole: write beside it, then switch.

A write that fails half way leaves the rows of the table as they were, and a
table may be replaced by rows that are read from it.  The switch are two renames
(old aside, new in place).  A switch that was cut off between the two is undone
when the table is next published or read with :func:`read_published`.

One writer per table at a time is assumed; writers of different tables, or of
different partitions of one table, do not disturb each other.  The folders kept
beside a table start with an underscore, so readers of the parent pass over them.
On an object store, whose renames are copies, use a catalog table format instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.path = self._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._tag = hashlib.md5(self.path.getName().encode()).hexdigest()[:12]

    def _beside(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path.getParent(), name)

    @property
    def old(self):
        return self._beside(f"_old-{self._tag}")

    def new(self):
        return self._beside(f"_new-{self._tag}-{uuid.uuid4().hex}")

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def children(self) -> list[str]:
        """Names of what the folder holds, none if it is absent."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.exists() else []

    def settle(self) -> None:
        """Undo a switch that was cut off, and remove what failed writes left."""
        if self.fs.exists(self.old):
            if self.exists():
                self.fs.delete(self.old, True)
            else:
                self._rename(self.old, self.path)
        parent = self.path.getParent()
        if self.fs.exists(parent):
            for s in self.fs.listStatus(parent):
                if s.getPath().getName().startswith(f"_new-{self._tag}-"):
                    self.fs.delete(s.getPath(), True)

    def switch(self, new) -> None:
        """Put ``new`` in place of the folder."""
        had = self.exists()
        if had:
            self._rename(self.path, self.old)
        self._rename(new, self.path)
        if had:
            self.fs.delete(self.old, True)

    def _rename(self, a, b) -> None:
        if not self.fs.rename(a, b):
            raise OSError(f"cannot rename {a} to {b}")


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = (), replace: bool = True) -> None:
    """Write ``df`` as Parquet beside ``path``, then switch.  ``replace=False``
    refuses to replace a table that is there by then."""
    folder = Folder(df.sparkSession, path)
    folder.settle()
    new = folder.new()
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        w.parquet(new.toString())
        if partition_by and all(s.getPath().getName().startswith("_") for s in folder.fs.listStatus(new)):
            # No rows, so no partitions: an empty file keeps the columns.
            df.limit(0).write.mode("append").parquet(new.toString())
    except BaseException:
        folder.fs.delete(new, True)
        raise
    if not replace and folder.exists():
        folder.fs.delete(new, True)
        raise FileExistsError(f"{path} was written by another writer")
    folder.switch(new)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table as last published."""
    folder = Folder(spark, path)
    if not folder.exists():
        folder.settle()
    return spark.read.parquet(path)
