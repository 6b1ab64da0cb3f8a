"""Structural-break analytics for large collections of time series, on PySpark."""
