"""All queries over the reference operators, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from .views import duck

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
MODULES = ("metrics_queries", "text_queries", "transcript_queries", "trend_queries", "store_queries", "source_queries", "more_queries", "stream_queries")


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function and its DuckDB SQL, in which {names} are views."""

    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLE[name] = duck(oracle)
        return function

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f".{module}", __package__)


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
