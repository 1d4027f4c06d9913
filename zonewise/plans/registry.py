"""Registered queries and the SQL each one is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query, the inventory ids it covers, and its comparison SQL where there is one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = materialized(sql)
        return fn

    return wrap


def r6(expr: str) -> str:
    """SQL text of the half-up rounding used on both sides."""
    return f"(floor(({expr})*1e6+0.5)/1e6)"


def materialized(sql: str) -> str:
    """Ask the comparison engine to compute every named subquery once."""
    return re.sub(r"(\b\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", sql)
