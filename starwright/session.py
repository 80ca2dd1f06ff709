"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job in this package assumes.  UTC pins epoch seconds and
# month truncation; AQE re-plans joins and coalesces partitions at runtime;
# skew-join splitting covers hot customer / film / store keys.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime bloom filters: a selective side (e.g. date-filtered orders)
    # prunes the other side (lineitem) before its shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Remove reliable checkpoint files (surrogate-key pinning) once their
    # data is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(
    master: str | None = None,
    app_name: str = "starwright",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_runtime_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Apply the SQL settings to an existing session (e.g. the driver's)."""
    for key, value in DEFAULT_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only if none is set.

    ``spark.checkpoint.dir`` names a shared folder and is used as is.  Where it
    is unset, the folder is one below the warehouse, which driver and executors
    share by definition; machine-local temporary folders are never used.  On a
    cluster, a warehouse on the driver's own disk is refused.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            local = "://" not in warehouse or warehouse.startswith("file:")
            if local and not sc.master.startswith("local"):
                raise RuntimeError(f"set spark.checkpoint.dir to a shared folder: {warehouse} is on the driver's disk")
            folder = f"{warehouse}/_checkpoints"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
