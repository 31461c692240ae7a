"""Mapping tables given as nested maps in three shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_mapping(cfg: DataFrame, shape: str) -> DataFrame:
    """Turn a one-row config frame into a mapping table.

    ``by_weekend_id`` / ``weekend_id``: map weekend_id -> type, gives
    (weekend_id, track_type); ``by_season_round``: map season -> map round ->
    type, gives (season, round, track_type) with integer keys; any other
    shape gives an empty (weekend_id, track_type) table.
    """
    if shape in ("by_weekend_id", "weekend_id") and shape in cfg.columns:
        return cfg.select(F.explode(shape).alias("weekend_id", "track_type"))
    if shape == "by_season_round" and shape in cfg.columns:
        s = cfg.select(F.explode(shape).alias("season", "by_round"))
        r = s.select("season", F.explode("by_round").alias("round", "track_type"))
        return r.select(F.col("season").try_cast("int").alias("season"),
                        F.col("round").try_cast("int").alias("round"), "track_type")
    return cfg.sparkSession.createDataFrame([], "weekend_id string, track_type string")
