"""Participation spine (E1-E5): who takes part in which period.

All seasons resolve in one job: every candidate source is tagged with a
priority and, per season, only the best available source is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD = ["season", "round"]
CALENDAR_COLS = ["season", "round", "race_name", "circuit_id", "race_date"]


def dedupe_first(entries: DataFrame, keys: Sequence[str] = ("season", "round", "driver_id"),
                 order: str = "file_pos") -> DataFrame:
    """One row per key, the first in file order (deterministic, unlike dropDuplicates)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    return entries.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def _calendar(weekends: DataFrame) -> DataFrame:
    return weekends.select(*[c for c in CALENDAR_COLS if c in weekends.columns])


def entries_carry_forward(drivers: DataFrame, prev_results: DataFrame, weekends: DataFrame) -> DataFrame:
    """Current season drivers x that season's weekends; constructor from the
    previous season's last row of the driver; unknown -> 'unknown'.

    ``drivers``: (season, driver_id); ``prev_results``: (season, round,
    driver_id, constructor_id, file_pos) of any seasons.
    """
    last = (prev_results.groupBy((F.col("season") + 1).alias("season"), "driver_id")
            .agg(F.max_by("constructor_id", F.struct("round", "file_pos")).alias("constructor_id")))
    cur = drivers.select("season", "driver_id").distinct().join(last, ["season", "driver_id"], "left")
    cur = cur.withColumn("constructor_id", F.coalesce(F.col("constructor_id").cast("string"), F.lit("unknown")))
    return cur.join(_calendar(weekends), "season")


def entries_prev_season(prev_results: DataFrame, weekends: DataFrame) -> DataFrame:
    """Distinct (driver, constructor) pairs of season S-1 x weekends of S.

    A mid-season mover yields two pairs; E1 later keeps the first in file
    order (``file_pos`` = first appearance of the pair).
    """
    pairs = (prev_results.groupBy((F.col("season") + 1).alias("season"), "driver_id", "constructor_id")
             .agg(F.min("file_pos").alias("pair_pos")))
    return pairs.join(_calendar(weekends), "season")


def entries_override(mapping: DataFrame, weekends: DataFrame) -> DataFrame:
    """Manual (season, driver, constructor) mapping x the season's weekends."""
    return mapping.join(_calendar(weekends), "season")


def entries_precedence(candidates: dict[str, DataFrame]) -> DataFrame:
    """E5: per season the first available source of results -> override ->
    current drivers -> previous season, with provenance in ``source``.

    ``candidates`` maps source name to entries with (season, round,
    driver_id, constructor_id, file_pos); the dict order is the priority.
    """
    u = None
    for prio, (name, df) in enumerate(candidates.items()):
        part = df.select("season", "round", "driver_id", F.col("constructor_id").cast("string"),
                         F.col("file_pos").cast("bigint"), F.lit(prio).alias("priority"),
                         F.lit(name).alias("source"))
        u = part if u is None else u.unionByName(part)
    best = u.groupBy("season").agg(F.min("priority").alias("priority"))
    chosen = u.join(best, ["season", "priority"], "left_semi")
    return dedupe_first(chosen).drop("priority")
