"""Incremental derived tables on PySpark."""
