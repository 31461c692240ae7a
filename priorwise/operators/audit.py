"""U4: metamorphic leak audit of as-of features.

A feature row of period (S, r) may depend only on facts of earlier periods. So: alter everything in the facts from a cutoff on
(values moved, rows gone, rows doubled), build the features again, and compare. All rows up to and with the cutoff must
be as they were, whatever the feature and however it is computed. Rows are compared by fingerprints of each (column,
period), sums of hashes that do not depend on order, so the two builds are not joined and no feature is written twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = ["season", "round"]


def at_or_after(cutoff: tuple[int, int]) -> Column:
    season, round_ = cutoff
    return (F.col("season") > season) | ((F.col("season") == season) & (F.col("round") >= round_))


def altered(facts: DataFrame, cutoff: tuple[int, int], measures: Sequence[str], keys: Sequence[str] = ("driver_id",)) -> DataFrame:
    """The facts with all from the cutoff on changed: measures moved (null ones filled), a third of the rows gone, a fifth doubled.

    Which rows go depends on their keys and period alone.
    """
    late = at_or_after(cutoff)
    mark = F.pmod(F.xxhash64(*PERIOD, *keys), F.lit(15))
    moved = facts.withColumns({m: F.when(late, F.coalesce(F.col(m) * 3 + 7, F.lit(11))).otherwise(F.col(m)).cast(facts.schema[m].dataType)
                               for m in measures})
    copies = F.when(~late, 1).when(mark % 3 == 0, 0).when(mark % 5 == 1, 2).otherwise(1)
    return moved.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies))).where("__copy > 0").drop("__copy")


def fingerprints(frame: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(season, round, column_name, rows, fingerprint): the fingerprint does not depend on row order. Fractions count to 9 places."""
    kinds = dict(frame.dtypes)
    sums = []
    for i, c in enumerate(columns):
        value = F.round(F.col(c), 9) if kinds[c] in ("double", "float") else F.col(c)
        # a null is told apart from its absence
        sums.append(F.sum(F.xxhash64(*keys, F.lit(c), value.isNull(), value).cast("decimal(20,0)")).alias(f"__f{i}"))
    wide = frame.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("rows"), *sums)
    stack = ", ".join(f"'{c}', __f{i}" for i, c in enumerate(columns))
    return wide.selectExpr(*PERIOD, "rows", f"stack({len(columns)}, {stack}) AS (column_name, fingerprint)")


def metamorphic_audit(build: Callable[[Mapping[str, DataFrame]], DataFrame], facts: Mapping[str, DataFrame],
                      measures: Mapping[str, Sequence[str]], columns: Sequence[str], cutoff: tuple[int, int],
                      keys: Sequence[str] = ("driver_id",)) -> DataFrame:
    """Per feature column: checked_rows and checked_periods up to the cutoff, mismatched_periods among them, and changed_later:
    in how many later periods the feature did change, which shows that the audit can see it.

    ``build`` makes the feature frame of named fact frames; it is called for the facts and for their altered copy.
    """
    before = fingerprints(build(facts), columns, keys)
    after = fingerprints(build({n: altered(f, cutoff, measures.get(n, ()), keys) for n, f in facts.items()}), columns, keys)
    at = [*PERIOD, "column_name"]
    met = before.alias("a").join(after.alias("b"), at, "full_outer")
    same = F.col("a.fingerprint").eqNullSafe(F.col("b.fingerprint")) & F.col("a.rows").eqNullSafe(F.col("b.rows"))
    early = (F.col("season") < cutoff[0]) | ((F.col("season") == cutoff[0]) & (F.col("round") <= cutoff[1]))
    return met.groupBy("column_name").agg(
        F.sum(F.when(early, F.col("a.rows"))).alias("checked_rows"),
        F.sum(F.when(early, 1).otherwise(0)).alias("checked_periods"),
        F.sum(F.when(early & ~same, 1).otherwise(0)).alias("mismatched_periods"),
        F.sum(F.when(~early & ~same, 1).otherwise(0)).alias("changed_later"))
