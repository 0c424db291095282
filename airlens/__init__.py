"""airlens: air-quality analytics expressed as Spark DataFrame / SQL plans.

Subpackages
-----------
sources    table loaders, fixture views, file scans and sinks
functions  column-expression helpers (time, statistics, arithmetic, text)
operators  the query catalog, evaluation analytics, corpus building, bulletin ETL
plans      the query registry and its DuckDB oracle SQL
streaming  incremental (Structured Streaming) forms of the bulletin ETL
"""

__version__ = "0.1.0"
