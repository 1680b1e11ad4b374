"""All queries of the engine with their DuckDB SQL."""

from __future__ import annotations

from odweave.plans import flow_queries, model_queries, quality_queries, spatial_queries, table_queries
from odweave.plans.registry import QUERIES, SQL

__all__ = ["flow_queries", "model_queries", "oracle_sql", "quality_queries", "queries", "spatial_queries", "table_queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
