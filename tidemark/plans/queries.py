"""The registered queries and their SQL, by topic."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL_BY_QUERY: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with equivalent DuckDB SQL if there is one."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL_BY_QUERY[key] = sql
        return f

    return add


for _topic in ("convergence", "files", "activity", "contents", "tables", "streams"):
    import_module(f"tidemark.plans.{_topic}")
