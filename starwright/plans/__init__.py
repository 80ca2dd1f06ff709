"""The warehouse: dimensions, fact, dashboard marts and query catalogue."""
