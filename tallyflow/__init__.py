"""Counting, ranking, latency and bulk-movement operators on PySpark DataFrames."""
