"""Incremental (Structured Streaming) forms of the bulletin ETL."""
