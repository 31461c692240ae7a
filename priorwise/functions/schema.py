"""Schema contracts -- cast, add missing as NULL, order, drop extras."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enforce(df: DataFrame, contract: Sequence[tuple[str, str]]) -> DataFrame:
    """Select ``contract`` columns in order; absent ones become typed NULLs.

    Casts are ``try_cast`` so a value that does not fit becomes NULL instead
    of failing the job (Spark 4 runs with ANSI casts by default).
    """
    have = set(df.columns)
    cols = []
    for name, typ in contract:
        if name in have:
            cols.append(F.col(name).try_cast(typ).alias(name))
        else:
            cols.append(F.lit(None).cast(typ).alias(name))
    return df.select(*cols)


def align(df: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """Align a scoring frame to the training column list (missing -> NULL, extras dropped)."""
    types = types or {}
    have = set(df.columns)
    cols = []
    for c in columns:
        t = types.get(c, "double")
        cols.append(F.col(c).try_cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c))
    return df.select(*cols)
