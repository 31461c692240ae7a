"""Registry of the training-data queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a Spark query under ``name`` with its SQL, where SQL can say it."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from priorwise.llm import bpe, chat, decontaminate, exact_dedup, html_extract, jaccard_join, language  # noqa: F401
    from priorwise.llm import line_dedup, periodic, quality, substring_dedup, url_filter, whitening  # noqa: F401
    import corpus_pipeline  # noqa: F401
