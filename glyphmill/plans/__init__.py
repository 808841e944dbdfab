"""End-to-end plans and the registered queries over the driver tables."""

from __future__ import annotations

import importlib

_MODULES = ["corpus_queries", "text_queries", "vector_queries", "training_queries"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"glyphmill.plans.{name}")


def all_queries() -> dict:
    from glyphmill.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from glyphmill.plans.registry import SQL

    _load()
    return dict(SQL)
