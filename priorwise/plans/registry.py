"""Query registry: one Spark job and (where SQL can say it) one DuckDB oracle per operator.

Output conventions shared by both sides so results compare exactly:
integers are BIGINT, fractions DOUBLE rounded to 6 places, flags 0/1
BIGINT, dates ISO text, lower-case aliases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a Spark query under ``name`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def r6(c: Column | str) -> Column:
    """Round a fraction to 6 places as DOUBLE."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


def rounded(df: DataFrame) -> DataFrame:
    """Every fraction of a query's final select at 6 places (operators themselves never round)."""
    return df.select(*[r6(n).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def rounded_sql(columns: list[str]) -> str:
    """``* REPLACE`` list that rounds the given columns."""
    return "* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in columns) + ")"


def big(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint")


def load_all() -> None:
    """Import the modules that register queries."""
    from priorwise.plans import queries_asof  # noqa: F401
    from priorwise.plans import queries_etl  # noqa: F401
    from priorwise.plans import queries_model  # noqa: F401
    from priorwise.plans import queries_score  # noqa: F401
    from priorwise.plans import queries_spine  # noqa: F401
    from priorwise.plans import queries_io  # noqa: F401
    from priorwise.plans import queries_update  # noqa: F401
