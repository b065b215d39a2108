"""spendlens — card-spend analytics as Spark DataFrame operators.

Layers
------
``sources``    read extracts (CSV / JSON layouts), the fact table, sinks.
``functions``  Column-level building blocks (parsing, rounding, months, labels).
``operators``  DataFrame -> DataFrame operators (clean, filter, aggregate,
               window, reshape, request log).
``plans``      whole analyses composed from operators (charts, dashboard, ETL)
               and the query catalog used by ``__spark_entry__``.
``streaming``  incremental ingest with Structured Streaming.
"""

__version__ = "0.1.0"
