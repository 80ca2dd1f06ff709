"""Sources and sinks: Parquet/catalog tables, delimited files with a
rejects table, previews, and writers."""
