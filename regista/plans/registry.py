"""The table of registered queries: a function of (spark, sf_dir) and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regista.plans.views import VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """``sql`` with the definitions of the views it names, and of those they name, put before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEW_SQL and name not in needed:
                need(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {ctes}" + (",\n" + body[4:].lstrip() if body.upper().startswith("WITH") else "\n" + body)


def query(sql: str | None = None, name: str | None = None, complete: bool = False) -> Callable:
    """Register a function under its name, or ``name``; ``complete`` SQL holds the views it needs already."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or function.__name__] = function
        if sql:
            ORACLES[name or function.__name__] = sql if complete else with_views(sql)
        return function

    return add
