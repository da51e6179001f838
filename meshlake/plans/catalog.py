"""All registered queries of the mesh diagnostics."""

from __future__ import annotations

from meshlake.plans import basin_queries, contour_queries, deep_queries, field_queries, iterative_queries, mesh_queries, more_queries, section_queries, transport_queries  # noqa: F401
from meshlake.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
