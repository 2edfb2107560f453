"""Registry of named queries: Spark callable (spark, sf_dir) -> DataFrame and,
where the semantics are SQL-expressible, the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}   # query -> survey operator ids it covers


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = ops
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
