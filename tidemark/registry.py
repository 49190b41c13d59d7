"""Registry of the library's queries and of the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def load() -> None:
    for name in ("bars", "windows", "asof", "signals", "outcomes", "research", "logs", "books", "streams", "deep", "evidence", "replays", "grid", "archive"):
        importlib.import_module(f"tidemark.plans.{name}")
