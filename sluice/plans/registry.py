"""All named queries of the record engine and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from sluice.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The SQL with the views that it names in front."""
    used = [text for name, (_, text) in VIEWS.items() if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql)]
    sql = sql.strip()
    if not used:
        return sql
    if sql.upper().startswith("WITH "):
        recursive = "RECURSIVE " if sql.upper().startswith("WITH RECURSIVE ") else ""
        return f"WITH {recursive}" + ",\n".join(used) + ",\n" + sql[5 + len(recursive) :]
    return "WITH " + ",\n".join(used) + "\n" + sql


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL where SQL can express it."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = with_views(sql)
        return f

    return put


for module in ("insights", "lists", "text", "duplicates", "resolving", "merging", "ledgers", "audits", "reading", "bulk"):
    import_module(f"sluice.plans.{module}")
