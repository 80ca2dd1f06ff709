"""Dense surrogate keys (AUTO_INCREMENT re-expressed for a cluster)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starwright.session import ensure_checkpoint_dir

_PID, _MID, _BASE = "__sw_pid", "__sw_mid", "__sw_base"


def assign_key(df: DataFrame, key: str, order_by: str | Sequence[str], start: int = 1) -> DataFrame:
    """Add ``key`` = start, start+1, ... in ``order_by`` order, dense and unique.

    Equal to ``row_number() over (order by ...) + start - 1``, without moving
    the table into one task:

    1. range-partition on the order columns and sort inside each partition
       (AQE coalesces the ranges of a small table);
    2. tag every row with (partition id, position in partition) and pin the
       result with a reliable ``checkpoint()`` in the shared checkpoint
       folder, so a lost executor or a second action cannot renumber rows;
    3. count rows per partition (one row per partition), turn the counts
       into running offsets and broadcast them -- their size is bounded by
       the partition count, not by the data;
    4. key = start + offset(partition) + position.

    The order columns should be unique (a natural key); ties get an
    arbitrary order.
    """
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    # monotonically_increasing_id = (partition index << 33) + row position.
    position = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    counts = tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("__sw_n"))
    # One row per partition: the running sum is a bounded single-task window.
    offsets = counts.select(
        _PID,
        F.sum("__sw_n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)).alias(_BASE),
    ).fillna(0, subset=[_BASE])
    keyed = tagged.join(F.broadcast(offsets), _PID, "inner").withColumn(
        key, (F.lit(start) + F.col(_BASE) + position).cast("long")
    )
    return keyed.select(key, *df.columns)
