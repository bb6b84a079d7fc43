"""All queries of the market-analytics operators and their SQL."""

from __future__ import annotations

from . import alpha_queries, analysis_queries, indicator_queries, market_queries, scale_queries, stream_queries

_parts = (indicator_queries, alpha_queries, market_queries, analysis_queries, scale_queries, stream_queries)
QUERIES = {k: v for part in _parts for k, v in part.QUERIES.items()}
SQL = {k: v for part in _parts for k, v in part.SQL.items()}
