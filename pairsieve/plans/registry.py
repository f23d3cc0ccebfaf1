"""Name -> query and name -> reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Shared subquery for reference SQL; names start with ``v_``."""
    VIEWS[name] = sql


def _needed(text: str, seen: list[str]) -> None:
    for name in re.findall(r"\bv_\w+\b", text):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)


def complete(sql: str) -> str:
    """Put the shared subqueries that ``sql`` names in front of it."""
    names: list[str] = []
    _needed(sql, names)
    if not names:
        return sql.strip()
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    body = sql.strip()
    recursive = ""
    if re.match(r"(?i)with\s+recursive\b", body):
        recursive, body = "RECURSIVE ", re.sub(r"(?i)^with\s+recursive\b", ", ", body, count=1)
    elif re.match(r"(?i)with\b", body):
        body = re.sub(r"(?i)^with\b", ", ", body, count=1)
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = complete(sql)
        return fn

    return register
