"""Practice sessions and laps (P1-P9) as grouped and windowed DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorwise.functions.exprs import normalize_id
from priorwise.operators.ranking import ranked

SESSION = ["season", "round", "session_type"]
# Preferred practice session order for post-qualifying features.
SESSION_PREFERENCE = ["FP2", "FP3", "FP1"]


def lookup_last_wins(rows: DataFrame, key: str, value: str = "driver_id", order: str = "ordinal",
                     scope: Sequence[str] = ("season",)) -> DataFrame:
    """Key -> id map; for duplicate keys the last row (highest ordinal) wins.

    One row per key by construction, so joining it never fans out."""
    return (rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())
            .groupBy(*scope, key).agg(F.max_by(value, order).alias(value)))


def resolve_ids(rows: DataFrame, by_code: DataFrame, by_number: DataFrame,
                native: str = "native_id", codes: Sequence[str] = ("abbreviation", "driver_code"),
                number: str = "driver_number", scope: Sequence[str] = ("season",)) -> DataFrame:
    """Native id (trim, lower) -> code (trim, upper; columns in order) -> number.

    Lookups are per-season maps with one row per key (P1); they are joined
    with AQE choosing broadcast when they are small.
    """
    scope = list(scope)
    out = rows.withColumn("__r0", normalize_id(F.col(native)))
    parts = ["__r0"]
    for i, c in enumerate(codes):
        m = by_code.select(*scope, F.col("code").alias(f"__k{i}"), F.col("driver_id").alias(f"__r{i + 1}"))
        out = out.withColumn(f"__k{i}", normalize_id(F.col(c), upper=True)).join(m, scope + [f"__k{i}"], "left")
        parts.append(f"__r{i + 1}")
    mn = by_number.select(*scope, F.col("number").alias("__kn"), F.col("driver_id").alias("__rn"))
    out = out.withColumn("__kn", F.col(number).try_cast("bigint")).join(mn, scope + ["__kn"], "left")
    parts.append("__rn")
    out = out.withColumn("driver_id", F.coalesce(*[F.col(p) for p in parts]))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def session_best(results: DataFrame, laps: DataFrame, keys: Sequence[str] = (*SESSION, "driver_id")) -> DataFrame:
    """Reported session best, else the fastest valid lap of the driver."""
    keys = list(keys)
    lb = (laps.where(F.col("lap_time_ms").isNotNull() & F.col("driver_id").isNotNull())
          .groupBy(*keys).agg(F.min("lap_time_ms").alias("__lap_best")))
    out = results.join(lb, keys, "left")
    return out.withColumn("best_lap_time_ms", F.coalesce("best_lap_time_ms", "__lap_best")).drop("__lap_best")


def rank_fallback(results: DataFrame, session: Sequence[str] = SESSION) -> DataFrame:
    """When no row of a session has a position and some have a best lap,
    positions become the competition rank of the best lap (ties share the
    lowest rank; NULL laps stay unranked)."""
    known = results.groupBy(*session).agg((F.count("position") == 0).alias("__none"))
    out = ranked(results, session, "best_lap_time_ms", "__rank").join(known, list(session))
    return out.withColumn("position", F.when(F.col("__none"), F.col("__rank")).otherwise(F.col("position")).cast("bigint")) \
        .drop("__none", "__rank")


def dedupe_best(results: DataFrame, session: Sequence[str] = SESSION) -> DataFrame:
    """P5: one row per driver and session: lowest best lap (NULLs last), then
    lowest position; unresolved (NULL / empty) ids dropped."""
    r = results.withColumn("driver_id", normalize_id("driver_id")).where(F.col("driver_id").isNotNull())
    w = Window.partitionBy(*session, "driver_id").orderBy(F.col("best_lap_time_ms").asc_nulls_last(),
                                                          F.col("position").asc_nulls_last())
    return r.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def longrun_summary(laps: DataFrame, keys: Sequence[str] = (*SESSION, "driver_id"),
                    trim_frac: float = 0.2, min_n: int = 5) -> DataFrame:
    """Per driver long-run pace without in/out laps and NULL laps:
    count, median, mean and the trimmed mean (k = floor(0.2 n) off each end;
    plain mean when n < 5). No Python aggregate: ranks + conditional avg."""
    keys = list(keys)
    valid = laps.where(~F.coalesce(F.col("in_out"), F.lit(False)) & F.col("lap_time_ms").isNotNull())
    w = Window.partitionBy(*keys).orderBy("lap_time_ms", "event_id")
    wn = Window.partitionBy(*keys)
    v = valid.withColumns({"__rn": F.row_number().over(w), "__n": F.count(F.lit(1)).over(wn)})
    k = F.floor(F.col("__n") * trim_frac)
    keep = (F.col("__n") < min_n) | ((F.col("__rn") > k) & (F.col("__rn") <= F.col("__n") - k))
    return v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("practice_laps_count"),
        F.percentile("lap_time_ms", 0.5).alias("practice_longrun_med_ms"),
        F.avg("lap_time_ms").alias("practice_longrun_mean_ms"),
        F.avg(F.when(keep, F.col("lap_time_ms"))).alias("practice_longrun_trimmed_ms"))


def practice_agg(results: DataFrame, keys: Sequence[str] = ("season", "round", "driver_id")) -> DataFrame:
    """Per (season, round, driver): distinct sessions, min / mean / median best lap."""
    return results.groupBy(*keys).agg(
        F.count_distinct("session_type").alias("practice_sessions"),
        F.min("best_lap_time_ms").alias("practice_best_ms"),
        F.avg("best_lap_time_ms").alias("practice_mean_ms"),
        F.percentile("best_lap_time_ms", 0.5).alias("practice_median_ms"))


def practice_rank_gap_z(agg: DataFrame, value: str = "practice_best_ms",
                        period: Sequence[str] = ("season", "round")) -> DataFrame:
    """Within-round rank (min method), gap to the best and z-score with the
    sample std; z = 0.0 for everyone when the std is NULL or 0."""
    stats = agg.groupBy(*period).agg(F.min(value).alias("__min"), F.avg(value).alias("__avg"),
                                     F.stddev_samp(value).alias("__std"))
    std = F.col("__std")
    z = F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise((F.col(value) - F.col("__avg")) / std)
    return ranked(agg, period, value, "practice_rank").join(stats, list(period)).withColumns({
        "practice_gap_to_best_ms": F.col(value) - F.col("__min"),
        "practice_z": z,
    }).drop("__min", "__avg", "__std")


def preferred_session(df: DataFrame, period: Sequence[str] = ("season", "round"),
                      order: Sequence[str] = SESSION_PREFERENCE) -> DataFrame:
    """Per round keep only the most preferred session that has rows."""
    prio = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("session_type"))
    d = df.withColumn("__p", F.when(prio > 0, prio)).where(F.col("__p").isNotNull())
    best = d.groupBy(*period).agg(F.min("__p").alias("__p"))
    return d.join(best, list(period) + ["__p"], "left_semi").drop("__p")
