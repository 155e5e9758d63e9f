"""Incremental view maintenance on PySpark."""
