"""Registered queries: each runs an operator over whole given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["activity", "conversations", "outcomes", "queue", "records", "documents", "streams", "whole"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function, and its SQL when given."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def with_ctes(*parts: str) -> str:
    """``WITH`` clause from CTE texts, the last part being the query."""
    *ctes, body = parts
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body.strip()


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
