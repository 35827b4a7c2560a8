"""Registry of named queries over the driver tables and their DuckDB oracle SQL.

Each plan module registers ``name -> fn(spark, sf_dir) -> DataFrame`` and, when the
result is expressible in plain SQL, the equivalent DuckDB statement over the views
``region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations``. Column names and types of both sides match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return deco


def _load_all() -> None:
    # Importing the plan modules fills the registry.
    from factlens.plans import (  # noqa: F401
        q_text, q_chunks, q_retrieval, q_sampling, q_stats, q_keywords, q_verify, q_evidence, q_streaming,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
