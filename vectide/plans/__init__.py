"""Queries over the engine's tables, each with the SQL it must agree with."""

from __future__ import annotations

import importlib

from vectide.plans.registry import QUERIES, SQL, Query

MODULES = ("vector_queries", "filter_queries", "text_queries", "analytics_queries", "index_queries", "storage_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"vectide.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def sql() -> dict[str, str]:
    _load()
    return dict(SQL)
