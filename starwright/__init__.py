"""starwright: a Spark-native rental-warehouse builder and analytics layer.

Layout
------
sources/    reading source tables, delimited-file loading with rejects, sinks
functions/  column expressions (calendar attributes, flags, labels, money)
operators/  reusable DataFrame operators (keys, calendar, joins, reshaping,
            aggregates, data-quality checks, defaults)
plans/      the warehouse itself: dimensions, fact, dashboard marts, and the
            catalogue of registered queries over the driver's tables
streaming/  incremental staged loading of newly landed files
"""

__version__ = "0.1.0"
