"""Query registry: Spark plans keyed by SURVEY ids, with DuckDB oracle SQL."""
