"""Operators: ranking, the query catalog, evaluation, corpus and bulletin ETL."""
