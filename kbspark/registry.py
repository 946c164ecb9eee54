"""Queries and SQL of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable


def _registered() -> dict[str, tuple[Callable, str | None]]:
    from kbspark.plans import catalog, catalog_more

    return catalog_more.QUERIES | catalog.QUERIES


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items() if sql}
