"""Helpers shared by the operators: scans, staged tables in the shared folder, row payloads."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.session import scratch_path

# The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row(docs: DataFrame, **named: Column) -> DataFrame:
    """The whole input row as one struct ``row`` next to ``named`` columns.

    Working columns can then never clash with columns of the input.
    """
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       *[c.alias(n) for n, c in named.items()])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Pure ASCII text takes the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, UPPER.lower()))


def bounded_batches(spark: SparkSession, limit: int = 8_000_000) -> None:
    """Arrow batches of about ``limit`` bytes, not of so many rows of any length: for sessions that set no lower bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > limit:
        spark.conf.set(key, str(limit))


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def by_bytes(batches: Iterator[pd.Series], limit: int = 2_000_000) -> Iterator[pd.Series]:
    """Cut series of texts so that a piece has at most ``limit`` characters (or is one text): bounds memory."""
    for texts in batches:
        start, size = 0, 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if i > start and size + n > limit:
                yield texts.iloc[start:i]
                start, size = i, 0
            size += n
        if len(texts):
            yield texts.iloc[start:]
    give_back()
