"""Multi-operator pipelines and the query registry."""

from __future__ import annotations

import importlib

QUERY_MODULES = ("track_queries", "physics_queries", "timeline_queries", "scoring_queries", "calibration_queries", "context_queries", "pixel_queries", "record_queries", "lookup_queries")


def load_queries():
    """(queries, sql): importing the modules registers their queries."""
    for module in QUERY_MODULES:
        importlib.import_module(f"{__name__}.{module}")
    from .registry import QUERIES, SQL

    return QUERIES, SQL
