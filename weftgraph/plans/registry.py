"""The query registry: a name, a function (spark, sf_dir) -> DataFrame and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    """Import all modules that register queries."""
    from . import aggregate_queries, completion_queries, context_queries, fuzzy_queries, graph_queries, hook_queries, index_queries, join_queries, lifecycle_queries, mining_queries, mixed_queries, projection_queries, relational_queries, retrieval_queries, scalar_queries, set_queries, source_queries, store_queries, stream_queries, window_queries  # noqa: F401
