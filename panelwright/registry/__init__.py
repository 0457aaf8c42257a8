"""Registered queries with the SQL that another engine runs for the same result."""

from dataclasses import dataclass
from typing import Callable

_QUERIES: dict = {}


@dataclass(frozen=True)
class Query:
    run: Callable
    sql: str | None


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""
    def add(fn):
        _QUERIES[fn.__name__] = Query(fn, sql)
        return fn
    return add


def all_queries() -> dict:
    from panelwright.registry import (  # noqa: F401
        evaluation, files, identity, incremental, models, monthly, parsing, portfolio, scalars, snapshots, splits, trees)
    return dict(_QUERIES)
