"""All queries over the reference's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from . import filter_queries, polygon_queries, print_queries, raster_queries, report_queries

MODULES = (raster_queries, report_queries, print_queries, polygon_queries, filter_queries)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
