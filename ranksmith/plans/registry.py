"""The table of registered queries, filled by the catalog modules."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name`` with its DuckDB SQL."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
