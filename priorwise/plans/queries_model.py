"""Registered queries for training frames, models (M1-M19) and the assembled
post-practice / post-qualifying frames (F13-F19).

As-of point of the registered jobs: season 2000, round 7, training seasons
1995..2000; every round from there on is scored. The qualifying model learns from the baseline with practice and scores
post-practice rows; the race models learn from and score post-qualifying rows. Each model is fitted once with the full number of
trees (500, 700, 400) and then found in the registry by name, as-of point and fingerprint of its rows and settings.
"""

from __future__ import annotations

import zlib
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions.schema import align
from priorwise.operators import sessions as P
from priorwise.operators import train as M
from priorwise.operators.asof import Agg, group_prior_stats, prior_stats
from priorwise.plans import carriers as K
from priorwise.plans import features as FT
from priorwise.plans.queries_asof import CTE_F12, F12_DOUBLES, SQL_SP
from priorwise.plans.queries_spine import P3_SQL
from priorwise.plans.carriers import with_carriers
from priorwise.plans.registry import big, r6, register, rounded, rounded_sql
from priorwise.operators.dist import rank_by_score, rank_distribution
from priorwise.plans.queries_score import HEAT, SAMPLES, with_heat
from priorwise.session import checkpoint_dir, scratch_path
from priorwise.sources.models import Artifact, ModelRegistry, fingerprint
from priorwise.sources.tables import staged

AS_OF = (2000, 7)
START, TRAIN_END = 1995, 2000
CONTRACT = FT.BASELINE_CONTRACT
ID_COLS = ["driver_id", "constructor_id", "circuit_id"]
PRACTICE = ["practice_sessions", "practice_best_ms", "practice_mean_ms", "practice_median_ms", "practice_rank",
            "practice_gap_to_best_ms", "practice_z"]
PRACTICE_DOUBLES = ["practice_best_ms", "practice_mean_ms", "practice_median_ms", "practice_gap_to_best_ms", "practice_z"]
NUMERIC = [n for n, t in CONTRACT if t in ("bigint", "double") and n not in ID_COLS + ["season", "round"]] + PRACTICE
CATEGORICAL = ["track_type"]


def _sql(ctes: str, select: str, *extra: str) -> str:
    return with_carriers(SQL_SP + CTE_F12 + ctes + "\n" + select, "k1", "k2", "k3", *extra)


AS_OF_SQL = (f"f.season BETWEEN {START} AND {min(AS_OF[0], TRAIN_END)} "
             f"AND (f.season < {AS_OF[0]} OR f.round < {AS_OF[1]})")

P8_CTE = """,
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
         CASE WHEN coalesce(stddev_samp(practice_best_ms) OVER (PARTITION BY season, round), 0) = 0 THEN 0.0
              ELSE (practice_best_ms - avg(practice_best_ms) OVER (PARTITION BY season, round))
                   / stddev_samp(practice_best_ms) OVER (PARTITION BY season, round) END AS practice_z
  FROM p7
)"""
POSTQ_CTE = """,
kq AS (SELECT season, round, driver_id, constructor_id AS q_constructor_id, qualifying_position FROM k1),
f14 AS (
  SELECT s.season, s.round, s.driver_id, coalesce(q.q_constructor_id, s.constructor_id) AS constructor_id,
         q.qualifying_position
  FROM sp s LEFT JOIN kq q ON q.season = s.season AND q.round = s.round AND q.driver_id = s.driver_id
),
f15 AS (
  SELECT f.season, f.round, f.driver_id, coalesce(k.constructor_id, f.constructor_id) AS constructor_id,
         f.qualifying_position, k.finish_position AS sprint_finish, k.grid_position AS sprint_grid,
         k.points AS sprint_points, CAST(k.dnf AS BIGINT) AS sprint_dnf
  FROM f14 f LEFT JOIN k9 k ON k.season = f.season AND k.round = f.round AND k.driver_id = f.driver_id
),
f16d AS (
  SELECT s.season, s.round, s.driver_id,
         avg(f.finish_position) AS sprint_avg_finish_season_prior,
         avg(f.dnf) AS sprint_dnf_rate_season_prior
  FROM f15 s LEFT JOIN k9 f ON f.driver_id = s.driver_id AND f.season = s.season AND f.round < s.round
  GROUP BY 1, 2, 3
),
f16c AS (
  SELECT s.season, s.round, s.driver_id, avg(f.finish_position) AS constructor_sprint_avg_finish_season_prior
  FROM f15 s LEFT JOIN k9 f ON f.constructor_id = s.constructor_id AND f.season = s.season AND f.round < s.round
  GROUP BY 1, 2, 3
),
f17 AS (
  SELECT season, round, driver_id,
         qualifying_position - avg(qualifying_position) OVER (PARTITION BY season, round, constructor_id)
           AS quali_vs_constructor_mean
  FROM f15
),
f18d AS (
  SELECT s.season, s.round, s.driver_id,
         avg(f.finish_position) AS race_avg_finish_season_prior,
         avg(f.dnf) AS race_dnf_rate_season_prior
  FROM f15 s LEFT JOIN k1 f ON f.driver_id = s.driver_id AND f.season = s.season AND f.round < s.round
  GROUP BY 1, 2, 3
),
f18c AS (
  SELECT s.season, s.round, s.driver_id, avg(f.finish_position) AS constructor_race_avg_finish_season_prior
  FROM f15 s LEFT JOIN k1 f ON f.constructor_id = s.constructor_id AND f.season = s.season AND f.round < s.round
  GROUP BY 1, 2, 3
)"""
LONGRUN_CTE = """,
pv AS (
  SELECT k.*, row_number() OVER (PARTITION BY season, round, session_type, driver_id ORDER BY lap_time_ms, event_id) AS rn,
         count(*) OVER (PARTITION BY season, round, session_type, driver_id) AS n
  FROM k4 k WHERE NOT coalesce(in_out, false) AND lap_time_ms IS NOT NULL
),
lr AS (
  SELECT season, round, session_type, driver_id,
         avg(CASE WHEN n < 5 OR (rn > floor(n * 0.2) AND rn <= n - floor(n * 0.2)) THEN lap_time_ms END) AS trimmed
  FROM pv GROUP BY 1, 2, 3, 4
),
lrp AS (
  SELECT * FROM (SELECT *, CASE session_type WHEN 'FP2' THEN 1 WHEN 'FP3' THEN 2 WHEN 'FP1' THEN 3 END AS p FROM lr) x
  WHERE p = (SELECT min(CASE session_type WHEN 'FP2' THEN 1 WHEN 'FP3' THEN 2 WHEN 'FP1' THEN 3 END)
             FROM lr y WHERE y.season = x.season AND y.round = x.round)
)"""


POSTQ_DOUBLES = ["sprint_avg_finish_season_prior", "sprint_dnf_rate_season_prior",
                 "constructor_sprint_avg_finish_season_prior", "quali_vs_constructor_mean",
                 "race_avg_finish_season_prior", "race_dnf_rate_season_prior", "constructor_race_avg_finish_season_prior",
                 *PRACTICE_DOUBLES, "practice_longrun_trimmed_ms"]
POSTQ_OUT = ["season", "round", "driver_id", "constructor_id", "weekend_id", "race_name", "circuit_id", "race_date",
             "track_type", "qualifying_position", "sprint_finish", "sprint_grid", "sprint_points", "sprint_dnf",
             *POSTQ_DOUBLES[:7], *PRACTICE, "practice_longrun_trimmed_ms"]

F19_CTE = POSTQ_CTE + P3_SQL + P8_CTE + LONGRUN_CTE + """,
f19 AS (
  SELECT CAST(b.season AS BIGINT) AS season, CAST(b.round AS BIGINT) AS round, b.driver_id, b.constructor_id,
         s.weekend_id, s.race_name, CAST(s.circuit_id AS BIGINT) AS circuit_id, s.race_date, s.track_type,
         b.qualifying_position, b.sprint_finish, b.sprint_grid, b.sprint_points, b.sprint_dnf,
         d.sprint_avg_finish_season_prior, d.sprint_dnf_rate_season_prior, e.constructor_sprint_avg_finish_season_prior,
         g.quali_vs_constructor_mean, r.race_avg_finish_season_prior, r.race_dnf_rate_season_prior,
         c.constructor_race_avg_finish_season_prior, CAST(coalesce(p.practice_sessions, 0) AS BIGINT) AS practice_sessions,
         p.practice_best_ms, p.practice_mean_ms, p.practice_median_ms, p.practice_rank, p.practice_gap_to_best_ms,
         p.practice_z, l.trimmed AS practice_longrun_trimmed_ms
  FROM f15 b
  JOIN sp s USING (season, round, driver_id)
  JOIN f16d d USING (season, round, driver_id)
  JOIN f16c e USING (season, round, driver_id)
  JOIN f17 g USING (season, round, driver_id)
  JOIN f18d r USING (season, round, driver_id)
  JOIN f18c c USING (season, round, driver_id)
  LEFT JOIN p8 p ON p.season = b.season AND p.round = b.round AND p.driver_id = b.driver_id
  LEFT JOIN lrp l ON l.season = b.season AND l.round = b.round AND l.driver_id = b.driver_id
)"""
# M1: the baseline and the practice of the round, which may be missing; rows with a qualifying position
M1_CTE = P3_SQL + P8_CTE + f""",
m1 AS (
  SELECT f.*, CAST(coalesce(p.practice_sessions, 0) AS BIGINT) AS practice_sessions, p.practice_best_ms, p.practice_mean_ms,
         p.practice_median_ms, p.practice_rank, p.practice_gap_to_best_ms, p.practice_z, q.qualifying_position
  FROM f12 f JOIN k1 q ON q.season = f.season AND q.round = f.round
                      AND q.driver_id = f.driver_id AND q.constructor_id = f.constructor_id
  LEFT JOIN p8 p ON p.season = f.season AND p.round = f.round AND p.driver_id = f.driver_id
  WHERE {AS_OF_SQL} AND q.qualifying_position IS NOT NULL
)"""
# M2: the post-qualifying frame; unknown finishes stay
M2_CTE = F19_CTE + f""",
m2 AS (
  SELECT f.*, q.finish_position, CAST(coalesce(q.dnf, 0) AS BIGINT) AS dnf
  FROM f19 f JOIN k1 q ON q.season = f.season AND q.round = f.round
                      AND q.driver_id = f.driver_id AND q.constructor_id = f.constructor_id
  WHERE {AS_OF_SQL}
)"""


def _m1(select: str) -> str:
    return _sql(M1_CTE, select, "k4s")


def _m2(select: str) -> str:
    return _sql(M2_CTE, select, "k9", "k4s")


def from_as_of() -> F.Column:
    """The rounds to score: all from the as-of point on."""
    return (F.col("season") > AS_OF[0]) | ((F.col("season") == AS_OF[0]) & (F.col("round") >= AS_OF[1]))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return K.results(spark, sf).select(big("season").alias("season"), big("round").alias("round"),
                                       "driver_id", "constructor_id", "qualifying_position",
                                       "finish_position", big("dnf").alias("dnf"))


def m1_frame(spark: SparkSession, sf: str, as_of: tuple[int, int] = AS_OF) -> DataFrame:
    """M1: baseline features with the practice of the round (sessions 0 where there was none), and the label."""
    # the narrow sides meet first: the wide features move once
    labels = _labels(spark, sf).join(_practice(spark, sf), ["season", "round", "driver_id"], "left") \
        .withColumn("practice_sessions", F.coalesce("practice_sessions", F.lit(0).cast("bigint")))
    return M.train_frame(FT.features_baseline(spark, sf), labels, [*PRACTICE, "qualifying_position"],
                         *as_of, START, TRAIN_END, drop_null=["qualifying_position"])


def m2_frame(spark: SparkSession, sf: str, as_of: tuple[int, int] = AS_OF) -> DataFrame:
    """M2: post-qualifying features and the labels; an unknown withdrawal counts as none."""
    labels = _labels(spark, sf).withColumn("dnf", F.coalesce("dnf", F.lit(0).cast("bigint")))
    return M.train_frame(features_post_quali(spark, sf), labels, ["finish_position", "dnf"], *as_of, START, TRAIN_END)


def m2_labels(spark: SparkSession, sf: str, as_of: tuple[int, int] = AS_OF) -> DataFrame:
    """The rows of ``m2_frame`` with their keys and labels alone: the base of F19 has its keys, each once."""
    labels = _labels(spark, sf).withColumn("dnf", F.coalesce("dnf", F.lit(0).cast("bigint")))
    rows = post_quali_base(spark, sf).select(big("season").alias("season"), big("round").alias("round"), "driver_id", "constructor_id")
    return M.train_frame(rows, labels, ["finish_position", "dnf"], *as_of, START, TRAIN_END)


@register("train_frame_quali", _m1(f"SELECT {rounded_sql(F12_DOUBLES + PRACTICE_DOUBLES)} FROM m1"))
def q_train_frame_quali(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m1_frame(spark, sf))


@register("train_frame_race", _m2(f"SELECT {rounded_sql(POSTQ_DOUBLES)} FROM m2"))
def q_train_frame_race(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m2_frame(spark, sf))


def _sanitize_sql() -> str:
    cols = []
    for n, t in CONTRACT:
        if t == "string" or n in ID_COLS:
            cols.append(f"coalesce(CAST({n} AS VARCHAR), '{M.MISSING}') AS {n}")
        else:
            cols.append(f"round(CAST({n} AS DOUBLE), 6) AS {n}")
    cols += [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in PRACTICE]
    cols.append("CAST(qualifying_position AS DOUBLE) AS qualifying_position")
    return "SELECT " + ", ".join(cols) + " FROM m1"


@register("sanitize", _m1(_sanitize_sql()))
def q_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.sanitize(m1_frame(spark, sf), id_cols=ID_COLS))


def _impute_sql() -> str:
    parts = []
    for c in NUMERIC:
        parts.append(f"""SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.5), 6) AS median,
  CAST(count({c}) AS BIGINT) AS nonnull, CAST(count(*) AS BIGINT) AS rows,
  CASE WHEN count({c}) = 0 THEN 'drop' WHEN count({c}) < count(*) THEN 'impute_indicator' ELSE 'impute' END
    AS action FROM m1""")
    return "\nUNION ALL\n".join(parts)


@register("impute_median_indicator", _m1(_impute_sql()))
def q_impute_median_indicator(spark: SparkSession, sf: str) -> DataFrame:
    st = M.fit_impute(staged(m1_frame(spark, sf).select(*NUMERIC), "impute"), NUMERIC)
    stack = ", ".join(f"'{c}', `{c}__median`, `{c}__nonnull`" for c in NUMERIC)
    rows = st.selectExpr(f"stack({len(NUMERIC)}, {stack}) AS (column_name, median, nonnull)", "__rows AS rows")
    action = (F.when(F.col("nonnull") == 0, "drop").when(F.col("nonnull") < F.col("rows"), "impute_indicator")
              .otherwise("impute"))
    return rows.select("column_name", r6("median").alias("median"), big("nonnull").alias("nonnull"),
                       big("rows").alias("rows"), action.alias("action"))


def _apply_impute_sql() -> str:
    return "\nUNION ALL\n".join(f"""SELECT season, round, driver_id, '{c}' AS column_name,
  round(CAST(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM m1)) AS DOUBLE), 6) AS value,
  CAST({c} IS NULL AS BIGINT) AS was_missing FROM m1 WHERE (SELECT count({c}) FROM m1) > 0""" for c in NUMERIC)


@register("impute_apply", _m1(_apply_impute_sql()))
def q_impute_apply(spark: SparkSession, sf: str) -> DataFrame:
    """M4 applied: one row per (row, column) of the imputed frame."""
    frame = staged(m1_frame(spark, sf).select("season", "round", "driver_id", *NUMERIC), "impute")
    stats = M.fit_impute(frame, NUMERIC).first().asDict()  # one row of column statistics
    out = M.apply_impute(frame, stats, NUMERIC)
    kept = [c for c in NUMERIC if c in out.columns]
    flag = {c: f"cast(`{c}__missing` as bigint)" if f"{c}__missing" in out.columns else "0L" for c in kept}
    stack = ", ".join(f"'{c}', cast(`{c}` as double), {flag[c]}" for c in kept)
    rows = out.selectExpr("season", "round", "driver_id", f"stack({len(kept)}, {stack}) AS (column_name, value, was_missing)")
    return rows.withColumn("value", r6("value"))


@register("onehot_codes", _m1("""
, vals AS (
  SELECT 'track_type' AS column_name, coalesce(track_type, '__MISSING__') AS value FROM m1
  UNION ALL SELECT 'circuit_id', CAST(circuit_id AS VARCHAR) FROM m1
)
SELECT column_name, value, CAST(freq AS BIGINT) AS freq,
       CAST(row_number() OVER (PARTITION BY column_name ORDER BY freq DESC, value) - 1 AS BIGINT) AS idx
FROM (SELECT column_name, value, count(*) AS freq FROM vals GROUP BY 1, 2) t"""))
def q_onehot_codes(spark: SparkSession, sf: str) -> DataFrame:
    s = M.sanitize(m1_frame(spark, sf), id_cols=ID_COLS)
    idx = M.onehot_index(s, ["track_type", "circuit_id"])
    return idx.select(F.col("column").alias("column_name"), "value", big("freq").alias("freq"), "idx")


@register("recency_weight", _m2("""SELECT season, round, driver_id,
  round(CAST(1.0 AS DOUBLE) + 0.1 * CAST(season - (SELECT min(season) FROM m2) AS DOUBLE), 6) AS weight FROM m2"""))
def q_recency_weight(spark: SparkSession, sf: str) -> DataFrame:
    w = M.recency_weight(m2_frame(spark, sf))
    return w.select("season", "round", "driver_id", r6("weight").alias("weight"))


@register("base_rate_recent", _m2("""SELECT round(avg(CAST(dnf AS DOUBLE)), 6) AS base_rate,
  CAST(count(*) AS BIGINT) AS rows, min(season) AS from_season, max(season) AS to_season
FROM m2 WHERE season >= (SELECT max(season) FROM m2) - 6"""))
def q_base_rate_recent(spark: SparkSession, sf: str) -> DataFrame:
    b = M.base_rate_recent(m2_frame(spark, sf))
    return b.select(r6("base_rate").alias("base_rate"), big("rows").alias("rows"),
                    big("from_season").alias("from_season"), big("to_season").alias("to_season"))


@register("calibration_split", _m2("""SELECT CASE WHEN season < (SELECT max(season) FROM m2)
  THEN 'train' ELSE 'calibrate' END AS split, CAST(count(*) AS BIGINT) AS rows,
  min(season) AS from_season, max(season) AS to_season FROM m2 GROUP BY 1"""))
def q_calibration_split(spark: SparkSession, sf: str) -> DataFrame:
    c = M.calibration_split(m2_frame(spark, sf))
    return c.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("season").alias("from_season"),
                                  F.max("season").alias("to_season"))


@register("rescale_to_rate", _m2("""
, base AS (SELECT avg(CAST(dnf AS DOUBLE)) AS base_rate FROM m2 WHERE season >= (SELECT max(season) FROM m2) - 6),
sc AS (SELECT season, round, driver_id, coalesce(driver_season_dnf_rate_prior, 0.0) AS p FROM f12
),
mn AS (SELECT season, round, avg(p) AS mean_p FROM sc GROUP BY 1, 2)
SELECT s.season, s.round, s.driver_id,
       round(CASE WHEN m.mean_p > 0 THEN least(1.0, greatest(0.0, s.p * b.base_rate / m.mean_p)) ELSE s.p END, 6)
         AS p_rescaled
FROM sc s JOIN mn m USING (season, round) CROSS JOIN base b"""))
def q_rescale_to_rate(spark: SparkSession, sf: str) -> DataFrame:
    # the rate needs the frame's keys and labels, the score one prior: neither needs the stored feature tables
    base = M.base_rate_recent(m2_labels(spark, sf))
    sp, facts = FT.baseline_inputs(spark, sf)
    f = FT.reliability(sp.select(big("season").alias("season"), big("round").alias("round"), "driver_id"), facts)
    sc = f.select("season", "round", "driver_id",
                  F.coalesce(F.col("driver_season_dnf_rate_prior"), F.lit(0.0)).alias("p"))
    r = M.rescale_to_rate(sc, base)
    return r.select("season", "round", "driver_id", r6("p_rescaled").alias("p_rescaled"))


ALIGN_COLS = ["driver_q_avg_pos_season_prior", "driver_season_dnf_rate_prior", "practice_best_ms",
              "driver_constructor_tenure_rounds_prior"]


@register("align_features", _sql("", f"""SELECT round(driver_q_avg_pos_season_prior, 6) AS driver_q_avg_pos_season_prior,
  round(driver_season_dnf_rate_prior, 6) AS driver_season_dnf_rate_prior,
  CAST(NULL AS DOUBLE) AS practice_best_ms,
  CAST(driver_constructor_tenure_rounds_prior AS DOUBLE) AS driver_constructor_tenure_rounds_prior
FROM f12 WHERE season > {AS_OF[0]} OR season = {AS_OF[0]} AND round >= {AS_OF[1]}"""))
def q_align_features(spark: SparkSession, sf: str) -> DataFrame:
    f = FT.features_baseline(spark, sf).where(from_as_of())
    return rounded(align(f.withColumn("extra_col", F.lit(1)), ALIGN_COLS))


@register("train_cutoff", with_carriers(f"""
SELECT CAST(least((SELECT max(season) FROM k1 WHERE qualifying_position IS NOT NULL),
                  (SELECT max(season) FROM k1 WHERE finish_position IS NOT NULL), {TRAIN_END}) + 1 AS BIGINT)
         AS target_season, CAST(1 AS BIGINT) AS target_round""", "k1"))
def q_train_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    k1 = K.results(spark, sf)
    return M.train_cutoff(k1.where(F.col("qualifying_position").isNotNull()),
                          k1.where(F.col("finish_position").isNotNull()), TRAIN_END)


# ---------------------------------------------------------------------------
# Models (rows-only checks): sanitise -> impute -> index and one-hot -> fit, kept in the registry
# ---------------------------------------------------------------------------
MODEL_NUMERIC = ["season", "round", *NUMERIC]
RACE_NUMERIC = ["season", "round", "qualifying_position", "sprint_finish", "sprint_grid", "sprint_points", "sprint_dnf", *POSTQ_DOUBLES[:7],
                *PRACTICE, "practice_longrun_trimmed_ms"]
MODEL_CATEGORICAL = [*ID_COLS, "weekend_id", *CATEGORICAL]
ROW = {"season": "row_season", "round": "row_round", "driver_id": "row_driver"}  # keys beside the features


def model_input(df: DataFrame) -> DataFrame:
    """M3 with the row's keys kept next to the sanitised features."""
    keyed = df.select("*", *[F.col(k).alias(v) for k, v in ROW.items()])
    return M.sanitize(keyed, id_cols=ID_COLS, exclude=list(ROW.values()))


def _scored(df: DataFrame, *extra) -> DataFrame:
    return df.select(*[F.col(v).alias(k) for k, v in ROW.items()], *extra)


def registry_of(spark: SparkSession, sf: str) -> ModelRegistry:
    """One registry for each data folder, in the shared folder."""
    return ModelRegistry(spark, f"{checkpoint_dir(spark).rstrip('/')}/models/{zlib.crc32(sf.encode()):08x}")


def fit_artifact(train: DataFrame, estimator, numeric: list[str], **meta) -> Artifact:
    """M4 + M5 + fit: medians and indicators of this frame, then the pipeline. ``train`` is a stored frame."""
    stats = M.fit_impute(train, numeric).first().asDict()  # one row of column statistics
    filled = M.apply_impute(train, stats, numeric)
    used = [c for c in numeric if c in filled.columns] + [c for c in filled.columns if c.endswith("__missing")]
    model = M.feature_pipeline(used, MODEL_CATEGORICAL, estimator).fit(filled)
    return Artifact(model, {**meta, "stats": stats, "numeric": used, "inputs": numeric})


def settings_of(estimator, **more) -> dict:
    """What a fit depends on besides its rows."""
    return {"estimator": type(estimator).__name__, **{p.name: v for p, v in estimator.extractParamMap().items()},
            "categorical": MODEL_CATEGORICAL, **more}


def stage_frame(df: DataFrame, rows_per_partition: int = 50_000) -> DataFrame:
    path = scratch_path(df.sparkSession, "model-input")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.repartition(back.count() // rows_per_partition + 1)


def prepared(rows: DataFrame, artifact: Artifact) -> DataFrame:
    """Scoring rows with the training frame's imputation and columns; absent ones as missing."""
    s = model_input(rows)
    for c in artifact.meta["inputs"]:
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast("double"))
    for c in MODEL_CATEGORICAL:
        if c not in s.columns:
            s = s.withColumn(c, F.lit(M.MISSING))
    return M.apply_impute(s, artifact.meta["stats"], artifact.meta["inputs"])


def _scoring_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the qualifying model scores: post-practice features."""
    return features_post_practice(spark, sf).where(from_as_of())


def _race_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the race models score: post-qualifying features."""
    return features_post_quali(spark, sf).where(from_as_of())


def trained(spark: SparkSession, sf: str, name: str, frame: DataFrame, estimator, numeric: list[str], as_of: tuple[int, int] = AS_OF,
            **meta) -> Artifact:
    """The registry's model of these very rows and settings, or a new one."""
    frame = stage_frame(frame)
    knows = fingerprint(frame, settings_of(estimator, numeric=numeric, **meta))
    return registry_of(spark, sf).load_or_train(name, *as_of, lambda: fit_artifact(frame, estimator, numeric, **meta), knows)


def quali_model(spark: SparkSession, sf: str, as_of: tuple[int, int] = AS_OF) -> Artifact:
    """M6, from the registry."""
    return trained(spark, sf, "quali", model_input(m1_frame(spark, sf, as_of)), M.position_regressor("qualifying_position"), MODEL_NUMERIC, as_of)


def finish_model(spark: SparkSession, sf: str, as_of: tuple[int, int] = AS_OF) -> Artifact:
    """M7, from the registry."""
    known = model_input(m2_frame(spark, sf, as_of).where(F.col("finish_position").isNotNull()))
    est = M.position_regressor("finish_position", trees=700, weight="weight", min_instances=5)
    return trained(spark, sf, "finish", M.recency_weight(known), est, RACE_NUMERIC, as_of)


def event_model(spark: SparkSession, sf: str, part: str = "all") -> Artifact:
    """M10, from the registry, on all rows or (``part`` 'train') without the calibration season.

    Base rate and class weight are those of the whole frame either way; a rate of 0 or 1 has a constant predictor."""
    frame = m2_frame(spark, sf)
    base = M.base_rate_recent(frame).first()["base_rate"]
    if base is None or base <= 0 or base >= 1:
        return Artifact(None, {"base_rate": base or 0.0})
    if part == "train":
        frame = M.calibration_split(frame).where(F.col("split") == "train").drop("split")
    weighted = M.class_weight(M.recency_weight(model_input(frame)), "dnf", base)
    return trained(spark, sf, f"event-{part}", weighted, M.event_classifier("dnf", weight="event_weight"), RACE_NUMERIC, base_rate=base)


def side_by_side(*fits):
    """Results of independent fits that run at the same time: a fit is a chain of many small jobs that leave most cores idle."""
    with ThreadPoolExecutor(len(fits)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(fit)) for fit in fits]]


def position_scores(rows: DataFrame, artifact: Artifact) -> DataFrame:
    return _scored(artifact.model.transform(prepared(rows, artifact)), F.col("prediction").alias("score"))


def event_scores(rows: DataFrame, artifact: Artifact, *extra: str) -> DataFrame:
    if artifact.model is None:  # constant majority predictor
        return rows.select(*ROW, F.lit(float(artifact.meta["base_rate"] >= 0.5)).alias("p"), *extra)
    return _scored(M.event_probability(artifact.model, prepared(rows, artifact)), "p", *extra)


def race_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Race scoring end to end: finish score, event probability, calibrated (M12), rescaled to the base rate."""
    features_post_quali(spark, sf), _labels(spark, sf)  # stored before the fits, which share them
    split, event, finish = side_by_side(lambda: event_model(spark, sf, "train"), lambda: event_model(spark, sf), lambda: finish_model(spark, sf))
    held = M.calibration_split(m2_frame(spark, sf)).where(F.col("split") == "calibrate").drop("split")
    known = event_scores(held, split, "dnf").withColumn("dnf", F.col("dnf").cast("double"))
    iso = M.calibrate_isotonic(known, "p", "dnf").fit(known)
    rows = _race_rows(spark, sf)
    p = iso.transform(event_scores(rows, event))
    p = M.rescale_to_rate(p, float(split.meta["base_rate"]), p="p_cal", out="dnf_prob")
    score = position_scores(rows, finish)
    return score.join(p.select(*ROW, "p", "p_cal", "dnf_prob"), list(ROW))


@register("model_position")
def q_model_position(spark: SparkSession, sf: str) -> DataFrame:
    return position_scores(_scoring_rows(spark, sf), quali_model(spark, sf))


@register("model_finish")
def q_model_finish(spark: SparkSession, sf: str) -> DataFrame:
    return position_scores(_race_rows(spark, sf), finish_model(spark, sf))


@register("model_event")
def q_model_event(spark: SparkSession, sf: str) -> DataFrame:
    return event_scores(_race_rows(spark, sf), event_model(spark, sf))


@register("calibrate_isotonic")
def q_calibrate_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    """M12 + M13 on every round from the as-of point on."""
    return race_scores(spark, sf)


@register("race_distribution")
def q_race_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """D4 over the models: finish scores drawn with their withdrawal probabilities, in heats as in D3 and D4."""
    scores = with_heat(stage_frame(race_scores(spark, sf)))
    return rank_distribution(scores, SAMPLES, group=HEAT, withdraw_prob="dnf_prob", dense=False)


@register("score_frame")
def q_score_frame(spark: SparkSession, sf: str) -> DataFrame:
    return rank_by_score(position_scores(_scoring_rows(spark, sf), quali_model(spark, sf)))


@register("model_roundtrip")
def q_model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The model found by name, as-of point and fingerprint scores as it did when it was saved."""
    knows = quali_model(spark, sf).meta["knows"]
    found = registry_of(spark, sf).load("quali", *AS_OF, knows)
    return position_scores(_scoring_rows(spark, sf), found)


@register("importance_topk")
def q_importance_topk(spark: SparkSession, sf: str) -> DataFrame:
    artifact = quali_model(spark, sf)
    return M.importance_topk(artifact.model, 10, prepared(_scoring_rows(spark, sf), artifact))


@register("importance_values")
def q_importance_values(spark: SparkSession, sf: str) -> DataFrame:
    """The scored rows' values of the five most important features, one row a feature."""
    artifact = quali_model(spark, sf)
    rows = prepared(_scoring_rows(spark, sf), artifact)
    top = [r["feature"] for r in M.importance_topk(artifact.model, 5, rows).collect()]  # 5 rows
    values = {}
    for name in top:
        column, _, value = name.partition("=")  # a one-hot slot is column=value
        values[name] = (F.col(column) == value).cast("double") if value else F.col(column).cast("double")
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, v in values.items()])
    out = _scored(rows, F.explode(pairs).alias("f"))
    return out.select(*ROW, "f.feature", "f.value")


# ---------------------------------------------------------------------------
# Post-practice and post-qualifying frames
# ---------------------------------------------------------------------------
def practice_features(spark: SparkSession, sf: str) -> DataFrame:
    k4 = K.laps(spark, sf)
    p3 = P.session_best(K.session_results(spark, sf, k4), k4)
    return P.practice_rank_gap_z(P.practice_agg(p3))


def _practice(spark: SparkSession, sf: str) -> DataFrame:
    return practice_features(spark, sf).select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                                               big("practice_sessions").alias("practice_sessions"), *PRACTICE[1:])


@register("features_post_practice", _sql(P3_SQL + P8_CTE + """,
j AS (
  SELECT f.*, CAST(coalesce(p.practice_sessions, 0) AS BIGINT) AS practice_sessions, p.practice_best_ms,
         p.practice_mean_ms, p.practice_median_ms, p.practice_rank, p.practice_gap_to_best_ms, p.practice_z
  FROM f12 f LEFT JOIN p8 p ON p.season = f.season AND p.round = f.round AND p.driver_id = f.driver_id
)""", f"""SELECT {rounded_sql(F12_DOUBLES + PRACTICE_DOUBLES)} FROM (
  SELECT * EXCLUDE (mx) FROM (SELECT *, max(practice_sessions) OVER (PARTITION BY season, round) AS mx FROM j) t
  WHERE practice_sessions > 0 OR mx = 0) u""", "k4s"))
def q_features_post_practice(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features_post_practice(spark, sf))


def features_post_practice(spark: SparkSession, sf: str) -> DataFrame:
    """the whole baseline contract plus the practice features of the round."""
    return FT.attach_practice(FT.features_baseline(spark, sf), _practice(spark, sf))


POSTQ_KEYS = "CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id"


def post_quali_base(spark: SparkSession, sf: str) -> DataFrame:
    """F14 + F15: spine with round qualifying and sprint attached, constructors overridden."""
    sp = FT.baseline_spine(spark, sf)
    k1 = K.results(spark, sf)
    out = FT.attach_override(sp, k1.select("season", "round", "driver_id", "constructor_id", "qualifying_position"))
    k9 = K.sprint_results(spark, sf, k1).select(
        "season", "round", "driver_id", "constructor_id", F.col("finish_position").alias("sprint_finish"),
        F.col("grid_position").alias("sprint_grid"), F.col("points").alias("sprint_points"),
        big("dnf").alias("sprint_dnf"))
    return FT.attach_override(out, k9)


@register("attach_override", _sql(POSTQ_CTE, f"SELECT {POSTQ_KEYS}, constructor_id, qualifying_position FROM f14",
                                  "k9"))
def q_attach_override(spark: SparkSession, sf: str) -> DataFrame:
    sp = FT.baseline_spine(spark, sf).select("season", "round", "driver_id", "constructor_id")
    k1 = K.results(spark, sf).select("season", "round", "driver_id", "constructor_id", "qualifying_position")
    out = FT.attach_override(sp, k1)
    return out.select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                      "constructor_id", "qualifying_position")


@register("attach_sprint", _sql(POSTQ_CTE, f"""SELECT {POSTQ_KEYS}, constructor_id, sprint_finish, sprint_grid,
  sprint_points, sprint_dnf FROM f15""", "k9"))
def q_attach_sprint(spark: SparkSession, sf: str) -> DataFrame:
    b = post_quali_base(spark, sf)
    return b.select(big("season").alias("season"), big("round").alias("round"), "driver_id", "constructor_id",
                    "sprint_finish", "sprint_grid", "sprint_points", "sprint_dnf")


def sprint_priors(base: DataFrame, k9: DataFrame) -> DataFrame:
    out = prior_stats(base, k9, ["driver_id"], [
        Agg("sprint_avg_finish_season_prior", "avg", "finish_position"),
        Agg("sprint_dnf_rate_season_prior", "avg", "dnf")], scope="season")
    out = group_prior_stats(out, k9, ["constructor_id"], [
        Agg("constructor_sprint_avg_finish_season_prior", "avg", "finish_position")], scope="season", base=base)
    return out


@register("asof_sprint", _sql(POSTQ_CTE, f"""SELECT {POSTQ_KEYS}, round(d.sprint_avg_finish_season_prior, 6) AS sprint_avg_finish_season_prior,
  round(d.sprint_dnf_rate_season_prior, 6) AS sprint_dnf_rate_season_prior,
  round(c.constructor_sprint_avg_finish_season_prior, 6) AS constructor_sprint_avg_finish_season_prior
FROM f16d d JOIN f16c c USING (season, round, driver_id)""", "k9"))
def q_asof_sprint(spark: SparkSession, sf: str) -> DataFrame:
    b = post_quali_base(spark, sf)
    out = sprint_priors(b, K.sprint_results(spark, sf))
    return rounded(out.select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                              "sprint_avg_finish_season_prior", "sprint_dnf_rate_season_prior",
                              "constructor_sprint_avg_finish_season_prior"))


@register("round_group_delta", _sql(POSTQ_CTE, f"SELECT {POSTQ_KEYS}, round(quali_vs_constructor_mean, 6) AS quali_vs_constructor_mean FROM f17", "k9"))
def q_round_group_delta(spark: SparkSession, sf: str) -> DataFrame:
    b = post_quali_base(spark, sf)
    out = FT.round_group_delta(b, "qualifying_position", "quali_vs_constructor_mean")
    return out.select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                      r6("quali_vs_constructor_mean").alias("quali_vs_constructor_mean"))


def race_priors(base: DataFrame, k1: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    grid = grid if grid is not None else base
    out = prior_stats(base, k1, ["driver_id"], [
        Agg("race_avg_finish_season_prior", "avg", "finish_position"),
        Agg("race_dnf_rate_season_prior", "avg", "dnf")], scope="season")
    out = group_prior_stats(out, k1, ["constructor_id"], [
        Agg("constructor_race_avg_finish_season_prior", "avg", "finish_position")], scope="season", base=grid)
    return out


@register("asof_race_form", _sql(POSTQ_CTE, f"""SELECT {POSTQ_KEYS}, round(d.race_avg_finish_season_prior, 6) AS race_avg_finish_season_prior,
  round(d.race_dnf_rate_season_prior, 6) AS race_dnf_rate_season_prior,
  round(c.constructor_race_avg_finish_season_prior, 6) AS constructor_race_avg_finish_season_prior
FROM f18d d JOIN f18c c USING (season, round, driver_id)""", "k9"))
def q_asof_race_form(spark: SparkSession, sf: str) -> DataFrame:
    b = post_quali_base(spark, sf)
    out = race_priors(b, K.results(spark, sf))
    return rounded(out.select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                              "race_avg_finish_season_prior", "race_dnf_rate_season_prior",
                              "constructor_race_avg_finish_season_prior"))


def features_post_quali(spark: SparkSession, sf: str) -> DataFrame:
    """F19 as a stored, season-partitioned table."""
    return K.stored(spark, sf, "features_post_quali", lambda: build_post_quali(spark, sf)).select(*POSTQ_OUT)


@register("features_post_quali", _sql(F19_CTE, f"SELECT {rounded_sql(POSTQ_DOUBLES)} FROM f19", "k9", "k4s"))
def q_features_post_quali(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features_post_quali(spark, sf))


def build_post_quali(spark: SparkSession, sf: str) -> DataFrame:
    """spine, qualifying, sprint, priors of sprints and races, practice and long runs."""
    k1 = K.results(spark, sf)
    base = post_quali_base(spark, sf)
    b = sprint_priors(base, K.sprint_results(spark, sf, k1))
    mean = FT.round_group_delta(base, "qualifying_position", "quali_vs_constructor_mean")
    b = b.join(mean.select("season", "round", "driver_id", "quali_vs_constructor_mean"), ["season", "round", "driver_id"])
    b = race_priors(b, k1, base)
    lr = P.preferred_session(P.longrun_summary(K.laps(spark, sf))).select(
        big("season").alias("season"), big("round").alias("round"), "driver_id", "practice_longrun_trimmed_ms")
    b = b.withColumns({"season": big("season"), "round": big("round"), "circuit_id": big("circuit_id")})
    out = b.join(_practice(spark, sf), ["season", "round", "driver_id"], "left").join(lr, ["season", "round", "driver_id"], "left")
    out = out.withColumn("practice_sessions", F.coalesce(F.col("practice_sessions"), F.lit(0).cast("bigint")))
    return out.select(*POSTQ_OUT)
