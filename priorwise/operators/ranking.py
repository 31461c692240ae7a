"""Numbers and ranks within groups of any size, in two passes.

A window keyed by a round puts the whole round into one task. Here rows are dealt by *range* of (group, order), so a large
group spreads over many partitions and each partition holds one stretch of it. A first pass numbers the rows of each
partition; the counts of each (group, partition), a few rows, give the offsets of the stretches; a join adds them. Equal values
that straddle the edge of a range are ranked alike, as ranks of ties are taken over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.sources.tables import staged


def _met(a: DataFrame, b: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Frames ``a`` and ``b`` joined on equal columns, nulls alike; the columns of ``a`` and the others of ``b``."""
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    return a.alias("a").join(b.alias("b"), same, how).select("a.*", *[F.col(f"b.{c}").alias(c) for c in b.columns if c not in columns])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "number", parts: int | None = None) -> DataFrame:
    """Column ``out``: 1..n within each group by ``order`` (row_number, but for groups of any size).

    ``order`` should tell rows of a group apart, or equal rows are numbered in no fixed order. Rows are written down once, as
    ranges drawn twice need not be equal. ``parts``: number of ranges, else as many as Spark finds fit.
    """
    group, order = list(group), list(order)
    dealt = df.repartitionByRange(*([parts] if parts else []), *[F.col(g) for g in group], *order)
    kept = staged(dealt.sortWithinPartitions(*[F.col(g) for g in group], *order).withColumn("__id", F.monotonically_increasing_id())
                  .withColumn("__part", F.shiftright("__id", 33)), "ranges")
    counts = kept.groupBy(*group, "__part").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).drop("__n", "__first")
    met = _met(kept, offsets, [*group, "__part"])
    return met.select(*df.columns, (F.col("__id") + F.col("__offset")).cast("bigint").alias(out))


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, out: str, fold: str = "sum",
            parts: int | None = None) -> DataFrame:
    """Column ``out``: ``fold`` ('sum' or 'max') of ``value`` over the rows before this one in its group; null for the first.

    Ranges as in ``numbered``: the fold of whole earlier ranges comes by a join, that within a range by a window over it.
    """
    group, order, func = list(group), list(order), {"sum": F.sum, "max": F.max}[fold]
    dealt = df.repartitionByRange(*([parts] if parts else []), *[F.col(g) for g in group], *order)
    kept = staged(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    whole = kept.groupBy(*group, "__part").agg(func(value).alias("__all"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    before = whole.withColumn("__before", func("__all").over(earlier)).drop("__all")
    met = _met(kept, before, [*group, "__part"])
    within = func(value).over(Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = F.coalesce(F.col("__before") + within, "__before", within) if fold == "sum" else F.greatest("__before", within)
    return met.withColumn(out, both).drop("__part", "__before")


def ranked(df: DataFrame, group: Sequence[str], value: str, out: str = "rank", ties: str = "min", descending: bool = False,
           parts: int | None = None) -> DataFrame:
    """Column ``out``: rank of ``value`` within each group; null values have none.

    ``ties``: 'min' (equal values share the lowest of their numbers, bigint) or 'average' (their mean, double). Only distinct
    (group, value) pairs with their counts are dealt by range, so a value that many rows share is one row.
    """
    group = list(group)
    values = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    met = running(values, group, [F.col(value).desc() if descending else F.col(value).asc()], "__n", "__less", parts=parts)
    first = F.coalesce(F.col("__less"), F.lit(0)) + 1
    rank = first.cast("bigint") if ties == "min" else first + (F.col("__n") - 1) / 2.0
    ranks = met.select(*group, value, rank.alias(out))
    return _met(df, ranks, [*group, value], "left")
