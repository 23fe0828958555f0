"""Registered queries over the reference's own operators, each beside its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["family_queries", "catalogue_queries", "coverage_queries", "array_queries", "scalar_queries", "text_queries", "signal_queries", "window_queries", "status_queries", "report_queries"]


def collect() -> tuple[dict[str, Callable], dict[str, str]]:
    """All queries and their SQL."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"quakeloom.plans.{name}")
        if twice := queries.keys() & module.QUERIES.keys():
            raise ValueError(f"queries of one name: {sorted(twice)}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
