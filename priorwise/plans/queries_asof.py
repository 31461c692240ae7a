"""Registered queries for the as-of features (F1-F12) and the leak audit (U4).

Spark side: ``priorwise.operators.asof`` window jobs over the carriers.
Oracle side: brute-force range joins (``f.round < s.round``) in DuckDB, an
independent formulation of the same time rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.plans import carriers as K
from priorwise.plans import features as FT
from priorwise.plans.carriers import with_carriers
from priorwise.plans.registry import big, register, rounded, rounded_sql

KEYS = ["season", "round", "driver_id"]


def _keys_out(df: DataFrame, extra: list[str] | None = None) -> list:
    cols = [big("season").alias("season"), big("round").alias("round"), F.col("driver_id")]
    return cols + [F.col(c) for c in (extra or [])]


# ---------------------------------------------------------------------------
# SQL building blocks: spine (sp) and facts (kf) with context columns.
# ---------------------------------------------------------------------------
SQL_SP = """,
sp AS (
  SELECT s.season, s.round, s.driver_id, s.constructor_id, s.circuit_id, s.race_date,
         w.weekend_id, w.race_name, tt.track_type
  FROM k3 s
  LEFT JOIN k2 w ON s.season = w.season AND s.round = w.round
                AND s.circuit_id = w.circuit_id AND s.race_date = w.race_date
  LEFT JOIN k2_ttw tt ON tt.weekend_id = w.weekend_id
),
kf AS (
  SELECT f.*, w.circuit_id, tt.track_type,
         CASE WHEN f.dnf = 0 AND f.finish_position IS NOT NULL AND f.grid_position IS NOT NULL
              THEN f.finish_position - f.grid_position END AS fmg
  FROM k1 f JOIN k2 w ON f.season = w.season AND f.round = w.round
  LEFT JOIN k2_ttw tt ON tt.weekend_id = w.weekend_id
)"""

SP_PRIOR = "(f.season = s.season AND f.round < s.round)"
TP_PRIOR = "(f.season < s.season OR (f.season = s.season AND f.round < s.round))"

CTE_F3 = f""",
f3 AS (
  SELECT s.season, s.round, s.driver_id,
         count(f.qualifying_position) AS driver_season_quali_count_prior,
         avg(f.qualifying_position) AS driver_q_avg_pos_season_prior,
         quantile_cont(f.qualifying_position, 0.5) AS driver_q_med_pos_season_prior,
         min(f.qualifying_position) AS driver_q_best_pos_season_prior,
         max(f.qualifying_position) AS driver_q_worst_pos_season_prior
  FROM sp s LEFT JOIN kf f ON f.driver_id = s.driver_id AND {SP_PRIOR}
  GROUP BY 1, 2, 3
)"""

CTE_F4 = f""",
f4 AS (
  SELECT s.season, s.round, s.driver_id,
         count(f.qualifying_position) AS constructor_season_quali_count_prior,
         avg(f.qualifying_position) AS constructor_q_avg_pos_season_prior,
         min(f.qualifying_position) AS constructor_q_best_pos_season_prior
  FROM sp s LEFT JOIN kf f ON f.constructor_id = s.constructor_id AND {SP_PRIOR}
  GROUP BY 1, 2, 3
)"""

CTE_F5 = f""",
f5_pm AS (
  SELECT s.season, s.round, f.constructor_id, f.driver_id, avg(f.qualifying_position) AS m
  FROM (SELECT DISTINCT season, round, constructor_id FROM sp) s
  JOIN kf f ON f.constructor_id = s.constructor_id AND {SP_PRIOR}
  GROUP BY 1, 2, 3, 4
),
f5_tot AS (
  SELECT season, round, constructor_id, sum(m) AS tot, count(m) AS cnt FROM f5_pm GROUP BY 1, 2, 3
),
f5 AS (
  SELECT s.season, s.round, s.driver_id,
         p.m - (t.tot - p.m) / CASE WHEN t.cnt > 1 THEN t.cnt - 1 END
           AS driver_vs_teammate_q_avg_delta_season_prior
  FROM sp s
  LEFT JOIN f5_pm p ON p.season = s.season AND p.round = s.round
                   AND p.constructor_id = s.constructor_id AND p.driver_id = s.driver_id
  LEFT JOIN f5_tot t ON t.season = s.season AND t.round = s.round AND t.constructor_id = s.constructor_id
)"""

CTE_F6 = f""",
f6 AS (
  SELECT s.season, s.round, s.driver_id,
         count(f.driver_id) AS driver_season_race_starts_prior,
         CAST(coalesce(sum(f.dnf), 0) AS BIGINT) AS driver_season_dnfs_prior,
         CAST(sum(f.dnf) AS DOUBLE) / nullif(count(f.driver_id), 0) AS driver_season_dnf_rate_prior
  FROM sp s LEFT JOIN kf f ON f.driver_id = s.driver_id AND {SP_PRIOR}
  GROUP BY 1, 2, 3
)"""

CTE_F7 = """,
f7d AS (
  SELECT s.season, s.round, s.driver_id,
         count(f.qualifying_position) AS driver_career_quali_count_prior,
         avg(f.qualifying_position) AS driver_q_avg_pos_career_prior
  FROM sp s LEFT JOIN kf f ON f.driver_id = s.driver_id AND f.season < s.season
  GROUP BY 1, 2, 3
),
f7c AS (
  SELECT s.season, s.round, s.driver_id,
         count(f.qualifying_position) AS constructor_career_quali_count_prior,
         avg(f.qualifying_position) AS constructor_q_avg_pos_career_prior
  FROM sp s LEFT JOIN kf f ON f.constructor_id = s.constructor_id AND f.season < s.season
  GROUP BY 1, 2, 3
),
f7 AS (
  SELECT d.*, c.constructor_career_quali_count_prior, c.constructor_q_avg_pos_career_prior
  FROM f7d d JOIN f7c c USING (season, round, driver_id)
)"""

CTE_F8 = f""",
f8d AS (
  SELECT s.season, s.round, s.driver_id,
         count(f.qualifying_position) AS driver_q_count_at_circuit_prior,
         avg(f.qualifying_position) AS driver_q_avg_pos_at_circuit_prior
  FROM sp s LEFT JOIN kf f ON f.driver_id = s.driver_id AND f.circuit_id = s.circuit_id AND {TP_PRIOR}
  GROUP BY 1, 2, 3
),
f8c AS (
  SELECT s.season, s.round, s.driver_id,
         count(f.qualifying_position) AS constructor_q_count_at_circuit_prior,
         avg(f.qualifying_position) AS constructor_q_avg_pos_at_circuit_prior
  FROM sp s LEFT JOIN kf f ON f.constructor_id = s.constructor_id AND f.circuit_id = s.circuit_id
                          AND {TP_PRIOR}
  GROUP BY 1, 2, 3
)"""

CTE_F9 = f""",
f9d AS (
  SELECT s.season, s.round, s.driver_id, s.track_type,
         count(f.qualifying_position) AS driver_q_count_at_track_type_prior,
         avg(f.qualifying_position) AS driver_q_avg_pos_at_track_type_prior
  FROM sp s LEFT JOIN kf f ON f.driver_id = s.driver_id AND f.track_type = s.track_type AND {TP_PRIOR}
  GROUP BY 1, 2, 3, 4
),
f9c AS (
  SELECT s.season, s.round, s.driver_id,
         count(f.qualifying_position) AS constructor_q_count_at_track_type_prior,
         avg(f.qualifying_position) AS constructor_q_avg_pos_at_track_type_prior
  FROM sp s LEFT JOIN kf f ON f.constructor_id = s.constructor_id AND f.track_type = s.track_type
                          AND {TP_PRIOR}
  GROUP BY 1, 2, 3
)"""

CTE_F10 = f""",
f10 AS (
  SELECT s.season, s.round, s.driver_id,
         count(f.driver_id) AS driver_constructor_tenure_rounds_prior
  FROM sp s LEFT JOIN k3 f ON f.driver_id = s.driver_id AND f.constructor_id = s.constructor_id
                          AND {TP_PRIOR}
  GROUP BY 1, 2, 3
)"""

CTE_F11 = f""",
f11s AS (
  SELECT s.season, s.round, s.driver_id,
         avg(f.fmg) AS driver_finish_minus_grid_avg_season_prior,
         count(f.fmg) AS driver_finish_minus_grid_count_season_prior
  FROM sp s LEFT JOIN kf f ON f.driver_id = s.driver_id AND {SP_PRIOR}
  GROUP BY 1, 2, 3
),
f11c AS (
  SELECT s.season, s.round, s.driver_id,
         avg(f.fmg) AS driver_finish_minus_grid_avg_career_prior,
         count(f.fmg) AS driver_finish_minus_grid_count_career_prior
  FROM sp s LEFT JOIN kf f ON f.driver_id = s.driver_id AND f.season < s.season
  GROUP BY 1, 2, 3
),
f11 AS (
  SELECT a.*, b.driver_finish_minus_grid_avg_career_prior, b.driver_finish_minus_grid_count_career_prior
  FROM f11s a JOIN f11c b USING (season, round, driver_id)
)"""


def _sql(ctes: str, select: str) -> str:
    return with_carriers(SQL_SP + ctes + "\n" + select, "k1", "k2", "k3")


KEYS_SQL = "CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id"


# ---------------------------------------------------------------------------
# F1 / F2: spine joins
# ---------------------------------------------------------------------------
@register("spine_join", _sql("", f"""SELECT {KEYS_SQL}, constructor_id, weekend_id, race_name
FROM sp"""))
def q_spine_join(spark: SparkSession, sf: str) -> DataFrame:
    sp = FT.baseline_spine(spark, sf)
    return sp.select(*_keys_out(sp), "constructor_id", "weekend_id", "race_name")


@register("track_type_join", _sql("", f"""SELECT {KEYS_SQL}, weekend_id, track_type FROM sp"""))
def q_track_type_join(spark: SparkSession, sf: str) -> DataFrame:
    sp = FT.baseline_spine(spark, sf)
    return sp.select(*_keys_out(sp), "weekend_id", "track_type")


# ---------------------------------------------------------------------------
# F3 - F11
# ---------------------------------------------------------------------------
@register("asof_entity_season", _sql(CTE_F3, f"""SELECT {KEYS_SQL}, * EXCLUDE (season, round, driver_id) REPLACE (round(driver_q_avg_pos_season_prior, 6) AS driver_q_avg_pos_season_prior, round(driver_q_med_pos_season_prior, 6) AS driver_q_med_pos_season_prior)
FROM f3"""))
def q_asof_entity_season(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.entity_season_form(sp, facts)
    return rounded(out.select(*_keys_out(out), *FT.F3_COLS))


@register("asof_group_season", _sql(CTE_F4, f"""SELECT {KEYS_SQL}, * EXCLUDE (season, round, driver_id) REPLACE (round(constructor_q_avg_pos_season_prior, 6) AS constructor_q_avg_pos_season_prior)
FROM f4"""))
def q_asof_group_season(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.group_season_form(sp, facts)
    return rounded(out.select(*_keys_out(out), *FT.F4_COLS))


@register("asof_teammate_delta", _sql(CTE_F5, f"""SELECT {KEYS_SQL}, * EXCLUDE (season, round, driver_id) REPLACE (round(driver_vs_teammate_q_avg_delta_season_prior, 6) AS driver_vs_teammate_q_avg_delta_season_prior)
FROM f5"""))
def q_asof_teammate_delta(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.teammate_delta(sp, facts)
    return rounded(out.select(*_keys_out(out), "driver_vs_teammate_q_avg_delta_season_prior"))


@register("asof_reliability", _sql(CTE_F6, f"""SELECT {KEYS_SQL}, * EXCLUDE (season, round, driver_id) REPLACE (round(driver_season_dnf_rate_prior, 6) AS driver_season_dnf_rate_prior)
FROM f6"""))
def q_asof_reliability(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.reliability(sp, facts)
    return rounded(out.select(*_keys_out(out), *FT.F6_COLS))


@register("asof_career", _sql(CTE_F7, f"""SELECT {KEYS_SQL}, * EXCLUDE (season, round, driver_id) REPLACE (round(driver_q_avg_pos_career_prior, 6) AS driver_q_avg_pos_career_prior, round(constructor_q_avg_pos_career_prior, 6) AS constructor_q_avg_pos_career_prior)
FROM f7"""))
def q_asof_career(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.career_form(sp, facts)
    return rounded(out.select(*_keys_out(out), *FT.F7_COLS))


@register("asof_context_entity", _sql(CTE_F8, f"""SELECT {KEYS_SQL}, * EXCLUDE (season, round, driver_id) REPLACE (round(driver_q_avg_pos_at_circuit_prior, 6) AS driver_q_avg_pos_at_circuit_prior)
FROM f8d"""))
def q_asof_context_entity(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.circuit_form(sp, facts, who="driver")
    return rounded(out.select(*_keys_out(out), *FT.F8D_COLS))


@register("asof_context_group", _sql(CTE_F8, f"""SELECT {KEYS_SQL}, * EXCLUDE (season, round, driver_id) REPLACE (round(constructor_q_avg_pos_at_circuit_prior, 6) AS constructor_q_avg_pos_at_circuit_prior)
FROM f8c"""))
def q_asof_context_group(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.circuit_form(sp, facts, who="constructor")
    return rounded(out.select(*_keys_out(out), *FT.F8C_COLS))


@register("asof_context_type", _sql(CTE_F9, f"""SELECT {KEYS_SQL}, d.track_type,
  d.driver_q_count_at_track_type_prior, round(d.driver_q_avg_pos_at_track_type_prior, 6) AS driver_q_avg_pos_at_track_type_prior,
  c.constructor_q_count_at_track_type_prior,
  round(c.constructor_q_avg_pos_at_track_type_prior, 6) AS constructor_q_avg_pos_at_track_type_prior
FROM f9d d JOIN f9c c USING (season, round, driver_id)"""))
def q_asof_context_type(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.track_type_form(sp, facts)
    return rounded(out.select(*_keys_out(out), "track_type", *FT.F9_COLS))


@register("asof_tenure", _sql(CTE_F10, f"SELECT {KEYS_SQL}, driver_constructor_tenure_rounds_prior FROM f10"))
def q_asof_tenure(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.tenure(sp, K.entries(spark, sf))
    return rounded(out.select(*_keys_out(out), "driver_constructor_tenure_rounds_prior"))


@register("asof_finish_minus_grid", _sql(CTE_F11, f"""SELECT {KEYS_SQL}, * EXCLUDE (season, round, driver_id) REPLACE (round(driver_finish_minus_grid_avg_season_prior, 6) AS driver_finish_minus_grid_avg_season_prior, round(driver_finish_minus_grid_avg_career_prior, 6) AS driver_finish_minus_grid_avg_career_prior)
FROM f11"""))
def q_asof_finish_minus_grid(spark: SparkSession, sf: str) -> DataFrame:
    sp, facts = FT.baseline_inputs(spark, sf)
    out = FT.finish_minus_grid(sp, facts)
    return rounded(out.select(*_keys_out(out), *FT.F11_COLS))


# ---------------------------------------------------------------------------
# the assembled 40-column baseline frame
# ---------------------------------------------------------------------------
CTE_ALL = CTE_F3 + CTE_F4 + CTE_F5 + CTE_F6 + CTE_F7 + CTE_F8 + CTE_F9 + CTE_F10 + CTE_F11
F12_SELECT = f"""
SELECT CAST(s.season AS BIGINT) AS season, CAST(s.round AS BIGINT) AS round, s.weekend_id, s.race_name,
       CAST(s.circuit_id AS BIGINT) AS circuit_id, s.race_date, s.driver_id, s.constructor_id,
       'baseline' AS checkpoint, 'Q' AS session_type,
       f3.driver_season_quali_count_prior, f4.constructor_season_quali_count_prior,
       f7.driver_career_quali_count_prior, f7.constructor_career_quali_count_prior,
       f3.driver_q_avg_pos_season_prior, f3.driver_q_med_pos_season_prior,
       f3.driver_q_best_pos_season_prior, f3.driver_q_worst_pos_season_prior,
       f4.constructor_q_avg_pos_season_prior, f4.constructor_q_best_pos_season_prior,
       f5.driver_vs_teammate_q_avg_delta_season_prior,
       f6.driver_season_race_starts_prior, f6.driver_season_dnfs_prior, f6.driver_season_dnf_rate_prior,
       f7.driver_q_avg_pos_career_prior, f7.constructor_q_avg_pos_career_prior,
       f8d.driver_q_count_at_circuit_prior, f8d.driver_q_avg_pos_at_circuit_prior,
       f8c.constructor_q_count_at_circuit_prior, f8c.constructor_q_avg_pos_at_circuit_prior,
       s.track_type,
       f9d.driver_q_count_at_track_type_prior, f9d.driver_q_avg_pos_at_track_type_prior,
       f9c.constructor_q_count_at_track_type_prior, f9c.constructor_q_avg_pos_at_track_type_prior,
       f10.driver_constructor_tenure_rounds_prior,
       f11.driver_finish_minus_grid_avg_season_prior, f11.driver_finish_minus_grid_avg_career_prior,
       f11.driver_finish_minus_grid_count_season_prior, f11.driver_finish_minus_grid_count_career_prior
FROM sp s
JOIN f3 USING (season, round, driver_id) JOIN f4 USING (season, round, driver_id)
JOIN f5 USING (season, round, driver_id) JOIN f6 USING (season, round, driver_id)
JOIN f7 USING (season, round, driver_id) JOIN f8d USING (season, round, driver_id)
JOIN f8c USING (season, round, driver_id) JOIN f9d USING (season, round, driver_id)
JOIN f9c USING (season, round, driver_id) JOIN f10 USING (season, round, driver_id)
JOIN f11 USING (season, round, driver_id)"""
F12_DOUBLES = [n for n, t in FT.BASELINE_CONTRACT if t == "double"]
CTE_F12 = CTE_ALL + ",\nf12 AS (" + F12_SELECT + "\n)"
F12_SQL = _sql(CTE_F12, f"SELECT {rounded_sql(F12_DOUBLES)} FROM f12")


@register("features_baseline", F12_SQL)
def q_features_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(FT.features_baseline(spark, sf))


# ---------------------------------------------------------------------------
# U4: leak audit -- window priors vs a brute-force range join, mismatch counts
# ---------------------------------------------------------------------------
@register("leak_audit", _sql(CTE_F3 + CTE_F7, """
SELECT 'season_prior' AS prior_name, CAST(count(*) AS BIGINT) AS checked_rows, CAST(0 AS BIGINT) AS mismatches FROM f3
UNION ALL
SELECT 'career_prior', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT) FROM f7"""))
def q_leak_audit(spark: SparkSession, sf: str) -> DataFrame:
    from priorwise.plans.audit import leak_audit

    sp, facts = FT.baseline_inputs(spark, sf)
    return leak_audit(sp, facts)

