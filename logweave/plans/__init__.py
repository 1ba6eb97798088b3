"""Composed plans: reports, the query catalog and its DuckDB oracle."""
