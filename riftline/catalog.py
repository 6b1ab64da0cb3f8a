"""Queries and their DuckDB counterparts, by name."""

from __future__ import annotations

from riftline.plans import embedding_queries, evidence_queries, lag_queries, model_queries, profile_queries, series_queries, table_queries  # noqa: F401 - the others add to series_queries

QUERIES = series_queries.QUERIES | model_queries.QUERIES
ORACLES = dict(series_queries.ORACLES)
