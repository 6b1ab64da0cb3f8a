"""Operators on series: (series_id, t, value, period) rows in, one or more rows per series out."""
