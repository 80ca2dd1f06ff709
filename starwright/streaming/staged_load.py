"""Staged file loading, each file exactly once (COPY-into-table semantics).

A stage folder receives delimited files over time.  A Structured
Streaming file source remembers (in its checkpoint) which files it has
already read, so every run loads only new files; ``availableNow`` makes a
run process everything present and stop, like a scheduled COPY.  Each
micro-batch is cleaned and converted with the same rules as the batch
loader; good rows and rejects are written under ``batch_id=N`` with
overwrite, so a replayed batch (after a failure between write and commit)
replaces its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from starwright.sources.csv_load import CsvFormat, clean_fields, profile, reader_options, split_typed, text_schema


def _batch_writer(schema: T.StructType, fmt: CsvFormat, table_path: str, rejects_path: str, bare_n_is_null: bool):
    def write(batch: DataFrame, batch_id: int) -> None:
        # Two outputs from one micro-batch: keep the cleaned text for both
        # writes instead of reading the batch's files twice.
        text = clean_fields(batch, schema, fmt, bare_n_is_null).persist()
        try:
            rows, rejects = split_typed(text, ["file_name"], schema, fmt)
            rows.drop("file_name").write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")
            rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch_id={batch_id}")
        finally:
            text.unpersist()
    return write


def start_staged_load(
    spark: SparkSession,
    stage_path: str,
    schema: T.StructType,
    table_path: str,
    rejects_path: str,
    fmt: CsvFormat | str = "utf8",
    checkpoint_location: str | None = None,
    bare_n_is_null: bool = False,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start loading every not-yet-loaded file of ``stage_path``; returns the
    running query (it stops by itself once the present files are done).

    ``checkpoint_location`` defaults to a folder inside the target table (its
    name starts with an underscore, so readers pass over it): what was loaded
    is remembered wherever the rows are, whichever session loads next."""
    if isinstance(fmt, str):
        fmt = profile(fmt)
    if checkpoint_location is None:
        checkpoint_location = f"{table_path.rstrip('/')}/_staged_load"
    reader = spark.readStream.format("csv").options(**reader_options(fmt)).schema(text_schema(schema))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    text = reader.load(stage_path).withColumn("file_name", F.col("_metadata.file_name"))
    return (
        text.writeStream.foreachBatch(_batch_writer(schema, fmt, table_path, rejects_path, bare_n_is_null))
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )


def run_staged_load(*args, **kwargs) -> StreamingQuery:
    """:func:`start_staged_load` and wait until the present files are loaded."""
    q = start_staged_load(*args, **kwargs)
    q.awaitTermination()
    return q
