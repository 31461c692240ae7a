"""Registered queries for the participation spine (E1-E5) and practice sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.operators import sessions as P
from priorwise.operators import spine as E
from priorwise.plans import carriers as K
from priorwise.plans.carriers import with_carriers
from priorwise.plans.registry import big, r6, register
from priorwise.sources.tables import table

RESULTS_UNTIL = 1999     # seasons with published results in the precedence carrier
OVERRIDE_SEASON = 2001   # season with a manual override mapping (from supplier)
DUP_MOD = 7              # drivers % 7 = 0 get a later duplicate entry row


def _out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(big("season").alias("season"), big("round").alias("round"), "driver_id", *extra)


def _prev_results(spark: SparkSession, sf: str) -> DataFrame:
    return K.results(spark, sf).withColumn("file_pos", F.col("qualifying_position"))


# ---------------------------------------------------------------------------
# E1 - E5
# ---------------------------------------------------------------------------
@register("dedupe_first", with_carriers("""
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id, constructor_id FROM k3""",
                                        "k3"))
def q_dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    k3 = K.entries(spark, sf)
    raw = k3.withColumn("file_pos", F.struct(F.lit(0).alias("copy"), F.abs(F.col("driver_id")).alias("pos")))
    dups = (k3.where(F.col("driver_id") % DUP_MOD == 0)
            .withColumns({"constructor_id": F.col("constructor_id") + 100,
                          "file_pos": F.struct(F.lit(1).alias("copy"), F.abs(F.col("driver_id")).alias("pos"))}))
    out = E.dedupe_first(raw.unionByName(dups))
    return _out(out, "constructor_id")


CARRY_SQL = """,
last AS (
  SELECT season + 1 AS season, driver_id,
         arg_max(constructor_id, {'r': round, 'q': qualifying_position}) AS constructor_id
  FROM k1 GROUP BY 1, 2
),
e2 AS (
  SELECT d.season, w.round, d.driver_id, coalesce(CAST(l.constructor_id AS VARCHAR), 'unknown') AS constructor_id
  FROM (SELECT DISTINCT season, driver_id FROM k1) d
  LEFT JOIN last l USING (season, driver_id)
  JOIN k2 w ON w.season = d.season
)"""


@register("entries_carry_forward", with_carriers(CARRY_SQL + """
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id, constructor_id FROM e2""",
                                                 "k1", "k2"))
def q_entries_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    k1 = _prev_results(spark, sf)
    e2 = E.entries_carry_forward(k1.select("season", "driver_id"), k1, K.weekends(spark, sf))
    return _out(e2, "constructor_id")


PREV_SQL = """,
pairs AS (
  SELECT season + 1 AS season, driver_id, constructor_id, min({'r': round, 'q': qualifying_position}) AS pair_pos
  FROM k1 GROUP BY 1, 2, 3
),
e3 AS (
  SELECT season, round, driver_id, CAST(constructor_id AS VARCHAR) AS constructor_id FROM (
    SELECT p.*, w.round, row_number() OVER (PARTITION BY p.season, w.round, p.driver_id ORDER BY p.pair_pos) AS rn
    FROM pairs p JOIN k2 w ON w.season = p.season) t
  WHERE rn = 1
)"""


@register("entries_prev_season", with_carriers(PREV_SQL + """
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id, constructor_id FROM e3""",
                                               "k1", "k2"))
def q_entries_prev_season(spark: SparkSession, sf: str) -> DataFrame:
    k1 = _prev_results(spark, sf).withColumn("file_pos", F.struct("round", "qualifying_position"))
    e3 = E.entries_prev_season(k1, K.weekends(spark, sf)).withColumnRenamed("pair_pos", "file_pos")
    e3 = E.dedupe_first(e3.withColumn("constructor_id", F.col("constructor_id").cast("string")))
    return _out(e3, "constructor_id")


OVERRIDE_SQL = f""",
e4 AS (
  SELECT w.season, w.round, s.s_suppkey AS driver_id, CAST(s.s_nationkey AS VARCHAR) AS constructor_id
  FROM supplier s JOIN k2 w ON w.season = {OVERRIDE_SEASON}
)"""


def _override(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "supplier").select(
        F.lit(OVERRIDE_SEASON).alias("season"), F.col("s_suppkey").alias("driver_id"),
        F.col("s_nationkey").cast("string").alias("constructor_id"))
    return E.entries_override(m, K.weekends(spark, sf))


@register("entries_override", with_carriers(OVERRIDE_SQL + """
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id, constructor_id FROM e4""",
                                            "k2"))
def q_entries_override(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_override(spark, sf), "constructor_id")


@register("entries_precedence", with_carriers(CARRY_SQL + PREV_SQL + OVERRIDE_SQL + f""",
cand AS (
  SELECT season, round, driver_id, CAST(constructor_id AS VARCHAR) AS constructor_id,
         qualifying_position AS file_pos, 0 AS priority, 'results' AS source
  FROM k1 WHERE season <= {RESULTS_UNTIL}
  UNION ALL SELECT season, round, driver_id, constructor_id, 0, 1, 'override' FROM e4
  UNION ALL SELECT season, round, driver_id, constructor_id, 0, 2, 'current_drivers' FROM e2
  UNION ALL SELECT season, round, driver_id, constructor_id, 0, 3, 'previous_season' FROM e3
),
best AS (SELECT season, min(priority) AS priority FROM cand GROUP BY 1)
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id, constructor_id, source
FROM (SELECT c.*, row_number() OVER (PARTITION BY c.season, c.round, c.driver_id ORDER BY c.file_pos) AS rn
      FROM cand c JOIN best b USING (season, priority)) t
WHERE rn = 1""", "k1", "k2"))
def q_entries_precedence(spark: SparkSession, sf: str) -> DataFrame:
    k1 = _prev_results(spark, sf)
    wk = K.weekends(spark, sf)
    results = k1.where(F.col("season") <= RESULTS_UNTIL)
    current = E.entries_carry_forward(k1.select("season", "driver_id"), k1, wk).withColumn("file_pos", F.lit(0))
    prev = E.entries_prev_season(k1.withColumn("file_pos", F.struct("round", "qualifying_position")), wk)
    prev = E.dedupe_first(prev.withColumnRenamed("pair_pos", "file_pos")).withColumn("file_pos", F.lit(0))
    out = E.entries_precedence({
        "results": results,
        "override": _override(spark, sf).withColumn("file_pos", F.lit(0)),
        "current_drivers": current,
        "previous_season": prev,
    })
    return _out(out, "constructor_id", "source")


# ---------------------------------------------------------------------------
# P1 - P9 on K4 (events) and K7 (lookups with duplicate keys)
# ---------------------------------------------------------------------------
CODE_MOD, NUMBER_MOD = 40, 60


def _k7(spark: SparkSession, sf: str) -> DataFrame:
    u = K.laps(spark, sf).select("season", "driver_id").distinct()
    return u.select("season", F.format_string("u%d", "driver_id").alias("driver_id"),
                    F.format_string("C%d", F.col("driver_id") % CODE_MOD).alias("code"),
                    (F.col("driver_id") % NUMBER_MOD).alias("number"), F.col("driver_id").alias("ordinal"))


K7_SQL = f""",
k7 AS (
  SELECT DISTINCT season, 'u' || driver_id AS driver_id, 'C' || (driver_id % {CODE_MOD}) AS code,
         driver_id % {NUMBER_MOD} AS number, driver_id AS ordinal
  FROM k4
),
by_code AS (SELECT season, code, arg_max(driver_id, ordinal) AS driver_id FROM k7 GROUP BY 1, 2),
by_number AS (SELECT season, number, arg_max(driver_id, ordinal) AS driver_id FROM k7 GROUP BY 1, 2)"""


@register("lookup_last_wins", with_carriers(K7_SQL + """
SELECT CAST(season AS BIGINT) AS season, 'code' AS kind, code AS lookup_key, driver_id FROM by_code
UNION ALL
SELECT CAST(season AS BIGINT), 'number', CAST(number AS VARCHAR), driver_id FROM by_number""", "k4"))
def q_lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    k7 = _k7(spark, sf)
    c = P.lookup_last_wins(k7, "code")
    n = P.lookup_last_wins(k7, "number")
    return (c.select(big("season").alias("season"), F.lit("code").alias("kind"),
                     F.col("code").alias("lookup_key"), "driver_id")
            .unionByName(n.select(big("season").alias("season"), F.lit("number").alias("kind"),
                                  F.col("number").cast("string").alias("lookup_key"), "driver_id")))


@register("resolve_ids", with_carriers(K7_SQL + f"""
SELECT e.event_id, coalesce(
    CASE WHEN e.event_id % 3 = 0 THEN 'u' || e.driver_id END,
    c.driver_id, n.driver_id) AS driver_id
FROM k4 e
LEFT JOIN by_code c ON c.season = e.season AND e.event_id % 3 = 1
                   AND c.code = 'C' || (e.driver_id % {CODE_MOD})
LEFT JOIN by_number n ON n.season = e.season AND n.number = e.driver_id % {NUMBER_MOD}""", "k4"))
def q_resolve_ids(spark: SparkSession, sf: str) -> DataFrame:
    k4 = K.laps(spark, sf)
    rows = k4.select(
        "season", "event_id",
        F.when(F.col("event_id") % 3 == 0, F.format_string(" U%d ", "driver_id")).alias("native_id"),
        F.when(F.col("event_id") % 3 == 1, F.format_string("c%d", F.col("driver_id") % CODE_MOD)).alias("abbreviation"),
        F.lit(None).cast("string").alias("driver_code"),
        (F.col("driver_id") % NUMBER_MOD).alias("driver_number"))
    k7 = _k7(spark, sf)
    out = P.resolve_ids(rows, P.lookup_last_wins(k7, "code"), P.lookup_last_wins(k7, "number"))
    return out.select("event_id", "driver_id")


P3_SQL = """,
p3 AS (
  SELECT s.season, s.round, s.session_type, s.driver_id,
         coalesce(s.best_lap_time_ms, l.lap_best) AS best_lap_time_ms, s.position
  FROM k4s s LEFT JOIN (
    SELECT season, round, session_type, driver_id, min(lap_time_ms) AS lap_best
    FROM k4 WHERE lap_time_ms IS NOT NULL GROUP BY 1, 2, 3, 4) l
  USING (season, round, session_type, driver_id)
)"""


def _p3(spark: SparkSession, sf: str) -> DataFrame:
    k4 = K.laps(spark, sf)
    return P.session_best(K.session_results(spark, sf, k4), k4)


def _sess_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(big("season").alias("season"), big("round").alias("round"), "session_type",
                     "driver_id", *extra)


SESS_KEYS_SQL = "CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, session_type, driver_id"


@register("session_best", with_carriers(P3_SQL + f"""
SELECT {SESS_KEYS_SQL}, round(best_lap_time_ms, 6) AS best_lap_time_ms FROM p3""", "k4s"))
def q_session_best(spark: SparkSession, sf: str) -> DataFrame:
    return _sess_out(_p3(spark, sf), r6("best_lap_time_ms").alias("best_lap_time_ms"))


P4_SQL = """,
p4 AS (
  SELECT season, round, session_type, driver_id, best_lap_time_ms,
         CAST(CASE WHEN count(position) OVER s = 0 AND count(best_lap_time_ms) OVER s > 0
                   THEN CASE WHEN best_lap_time_ms IS NOT NULL THEN
                        rank() OVER (PARTITION BY season, round, session_type
                                     ORDER BY best_lap_time_ms ASC NULLS LAST) END
                   ELSE position END AS BIGINT) AS position
  FROM p3 WINDOW s AS (PARTITION BY season, round, session_type)
)"""


@register("rank_fallback", with_carriers(P3_SQL + P4_SQL + f"""
SELECT {SESS_KEYS_SQL}, position FROM p4""", "k4s"))
def q_rank_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _sess_out(P.rank_fallback(_p3(spark, sf)), "position")


@register("dedupe_best", with_carriers(P3_SQL + P4_SQL + """,
cand AS (
  SELECT season, round, session_type, 'u' || driver_id AS driver_id, best_lap_time_ms, position FROM p4
  UNION ALL
  SELECT season, round, session_type, 'u' || driver_id, best_lap_time_ms + 100, position FROM p4
  WHERE driver_id % 9 = 0
)
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, session_type, driver_id,
       round(best_lap_time_ms, 6) AS best_lap_time_ms, position
FROM (SELECT *, row_number() OVER (PARTITION BY season, round, session_type, driver_id
                                   ORDER BY best_lap_time_ms ASC NULLS LAST, position ASC NULLS LAST) AS rn
      FROM cand) t WHERE rn = 1""", "k4s"))
def q_dedupe_best(spark: SparkSession, sf: str) -> DataFrame:
    p4 = P.rank_fallback(_p3(spark, sf))
    base = p4.withColumn("driver_id", F.format_string("U%d ", "driver_id"))
    dup = (p4.where(F.col("driver_id") % 9 == 0)
           .withColumns({"driver_id": F.format_string(" u%d", "driver_id"),
                         "best_lap_time_ms": F.col("best_lap_time_ms") + 100}))
    unresolved = p4.where(F.col("driver_id") % 11 == 0).withColumn("driver_id", F.lit("  "))
    out = P.dedupe_best(base.unionByName(dup).unionByName(unresolved))
    return _sess_out(out, r6("best_lap_time_ms").alias("best_lap_time_ms"), "position")


P6_SQL = """,
p6v AS (
  SELECT *, row_number() OVER (PARTITION BY season, round, session_type, driver_id
                               ORDER BY lap_time_ms, event_id) AS rn,
         count(*) OVER (PARTITION BY season, round, session_type, driver_id) AS n
  FROM k4 WHERE NOT coalesce(in_out, false) AND lap_time_ms IS NOT NULL
)"""


@register("longrun_summary", with_carriers(P6_SQL + f"""
SELECT {SESS_KEYS_SQL}, count(*) AS practice_laps_count,
       round(quantile_cont(lap_time_ms, 0.5), 6) AS practice_longrun_med_ms,
       round(avg(lap_time_ms), 6) AS practice_longrun_mean_ms,
       round(avg(CASE WHEN n < 5 OR (rn > floor(n * 0.2) AND rn <= n - floor(n * 0.2)) THEN lap_time_ms END), 6)
         AS practice_longrun_trimmed_ms
FROM p6v GROUP BY 1, 2, 3, 4""", "k4"))
def q_longrun_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = P.longrun_summary(K.laps(spark, sf))
    return _sess_out(s, "practice_laps_count",
                     *[r6(c).alias(c) for c in ["practice_longrun_med_ms", "practice_longrun_mean_ms",
                                                 "practice_longrun_trimmed_ms"]])


@register("trimmed_mean", with_carriers("""
, tv AS (
  SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY lap_time_ms, event_id) AS rn,
         count(*) OVER (PARTITION BY driver_id) AS n
  FROM k4 WHERE NOT coalesce(in_out, false) AND lap_time_ms IS NOT NULL
)
SELECT driver_id, count(*) AS practice_laps_count,
       round(avg(CASE WHEN n < 5 OR (rn > floor(n * 0.2) AND rn <= n - floor(n * 0.2)) THEN lap_time_ms END), 6)
         AS practice_longrun_trimmed_ms
FROM tv GROUP BY 1""", "k4"))
def q_trimmed_mean(spark: SparkSession, sf: str) -> DataFrame:
    s = P.longrun_summary(K.laps(spark, sf), keys=["driver_id"])
    return s.select("driver_id", "practice_laps_count", r6("practice_longrun_trimmed_ms").alias("practice_longrun_trimmed_ms"))


P7_SQL = """,
p7 AS (
  SELECT season, round, driver_id, count(DISTINCT session_type) AS practice_sessions,
         min(best_lap_time_ms) AS practice_best_ms, avg(best_lap_time_ms) AS practice_mean_ms,
         quantile_cont(best_lap_time_ms, 0.5) AS practice_median_ms
  FROM p3 GROUP BY 1, 2, 3
),
p8 AS (
  SELECT *, CAST(CASE WHEN practice_best_ms IS NOT NULL THEN
                 rank() OVER (PARTITION BY season, round ORDER BY practice_best_ms ASC NULLS LAST) END AS BIGINT)
              AS practice_rank,
         practice_best_ms - min(practice_best_ms) OVER (PARTITION BY season, round) AS practice_gap_to_best_ms,
         CASE WHEN stddev_samp(practice_best_ms) OVER (PARTITION BY season, round) IS NULL
                OR stddev_samp(practice_best_ms) OVER (PARTITION BY season, round) = 0 THEN 0.0
              ELSE (practice_best_ms - avg(practice_best_ms) OVER (PARTITION BY season, round))
                   / stddev_samp(practice_best_ms) OVER (PARTITION BY season, round) END AS practice_z
  FROM p7
)"""


def _p7(spark: SparkSession, sf: str) -> DataFrame:
    return P.practice_agg(_p3(spark, sf))


@register("practice_agg", with_carriers(P3_SQL + P7_SQL + """
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id, practice_sessions,
       round(practice_best_ms, 6) AS practice_best_ms, round(practice_mean_ms, 6) AS practice_mean_ms,
       round(practice_median_ms, 6) AS practice_median_ms FROM p7""", "k4s"))
def q_practice_agg(spark: SparkSession, sf: str) -> DataFrame:
    a = _p7(spark, sf)
    return _out(a, "practice_sessions", *[r6(c).alias(c) for c in
                                          ["practice_best_ms", "practice_mean_ms", "practice_median_ms"]])


@register("practice_rank_gap_z", with_carriers(P3_SQL + P7_SQL + """
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id, practice_rank,
       round(practice_gap_to_best_ms, 6) AS practice_gap_to_best_ms, round(practice_z, 6) AS practice_z FROM p8""",
                                               "k4s"))
def q_practice_rank_gap_z(spark: SparkSession, sf: str) -> DataFrame:
    z = P.practice_rank_gap_z(_p7(spark, sf))
    return _out(z, "practice_rank", r6("practice_gap_to_best_ms").alias("practice_gap_to_best_ms"),
                r6("practice_z").alias("practice_z"))


@register("preferred_session", with_carriers(P3_SQL + """,
pr AS (SELECT *, CASE session_type WHEN 'FP2' THEN 1 WHEN 'FP3' THEN 2 WHEN 'FP1' THEN 3 END AS p FROM p3)
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, session_type, driver_id
FROM pr WHERE p = (SELECT min(p) FROM pr x WHERE x.season = pr.season AND x.round = pr.round)""", "k4s"))
def q_preferred_session(spark: SparkSession, sf: str) -> DataFrame:
    return _sess_out(P.preferred_session(_p3(spark, sf)))
