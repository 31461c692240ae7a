"""Registered queries for ranking, distributions, comparison and evaluation (D*, V*).

K8 predictions: score = season-prior mean qualifying position (F3), NULL
when the entity has no prior; predicted order by D1 (NULL last). Actuals are K1.

Position distributions are drawn for *heats*: the entities of a round in fields of at most
``FIELD`` by entity number, so a field is bounded however large a round grows. Actual positions
in a heat are the ranks of K1's positions within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorwise.operators import dist as D
from priorwise.operators import evaluate as V
from priorwise.plans import carriers as K
from priorwise.plans import features as FT
from priorwise.plans.carriers import with_carriers
from priorwise.plans.queries_asof import CTE_F3, SQL_SP
from priorwise.plans.registry import big, r6, register
from priorwise.sources.tables import staged

SAMPLES = 5000         # draws of each heat
TEMPERATURE = 1.0
SEED = 42
FIELD = 20             # entities of a heat at most
HEAT = ["season", "round", "heat"]

K8_SQL = CTE_F3 + f""",
k8 AS (
  SELECT s.season, s.round, s.driver_id, s.constructor_id,
         f3.driver_q_avg_pos_season_prior AS score
  FROM sp s JOIN f3 USING (season, round, driver_id)
),
k8r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY season, round ORDER BY score ASC NULLS LAST, driver_id)
              AS BIGINT) AS predicted_position
  FROM k8
)"""


def _sql(ctes: str, select: str) -> str:
    return with_carriers(SQL_SP + K8_SQL + ctes + "\n" + select, "k1", "k2", "k3")


def k8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """K8: per spine row a score from the season-prior mean."""
    sp, facts = FT.baseline_inputs(spark, sf)
    f3 = FT.entity_season_form(sp.select("season", "round", "driver_id", "constructor_id"), facts)
    return f3.select("season", "round", "driver_id", "constructor_id",
                     F.col("driver_q_avg_pos_season_prior").alias("score"))


def k8_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return D.rank_by_score(k8_scores(spark, sf))


def with_heat(df: DataFrame) -> DataFrame:
    return df.withColumn("heat", F.floor(F.col("driver_id") / FIELD).cast("bigint"))


def heat_actuals(spark: SparkSession, sf: str) -> DataFrame:
    """K1 with its positions ranked within each heat."""
    k1 = with_heat(K.results(spark, sf))
    q = Window.partitionBy(*HEAT).orderBy("qualifying_position")
    f = Window.partitionBy(*HEAT, "dnf").orderBy("finish_position")
    return k1.select(*HEAT, "driver_id", "dnf", F.row_number().over(q).cast("bigint").alias("qualifying_position"),
                     F.when(F.col("dnf") == 0, F.row_number().over(f)).cast("bigint").alias("finish_position"))


HEAT_SQL = f""",
k8h AS (SELECT *, CAST(floor(driver_id / {float(FIELD)}) AS BIGINT) AS heat FROM k8),
kh AS (
  SELECT season, round, heat, driver_id, dnf,
         CAST(row_number() OVER (PARTITION BY season, round, heat ORDER BY qualifying_position) AS BIGINT) AS qualifying_position,
         CAST(CASE WHEN dnf = 0 THEN row_number() OVER (PARTITION BY season, round, heat, dnf ORDER BY finish_position) END
              AS BIGINT) AS finish_position
  FROM (SELECT *, CAST(floor(driver_id / {float(FIELD)}) AS BIGINT) AS heat FROM k1) k
),
k8f AS (
  SELECT k.*, coalesce(k.score, max(k.score) OVER (PARTITION BY k.season, k.round, k.heat), 0.0) AS filled,
         count(*) OVER (PARTITION BY k.season, k.round, k.heat) AS n
  FROM k8h k
)"""


def _draws_sql(source: str, seed: str, name: str, extra: str) -> str:
    """CTEs ``{name}_0`` ... ``{name}`` with a uniform ``{name}_u`` for each (row of source, sample)."""
    h = f"md5(concat_ws('|', '{seed}', concat_ws('-', season, round, heat), driver_id))"
    ctes = f""",
{name}_0 AS (
  SELECT s.*, CAST(('0x' || substr(h, 1, 7)) AS BIGINT) + 1 AS a, CAST(('0x' || substr(h, 9, 7)) AS BIGINT) + 1 AS b{extra}
  FROM (SELECT *, {h} AS h FROM {source}) s{" CROSS JOIN range(0, " + str(SAMPLES) + ") t(t)" if extra else ""}
)"""
    last = f"{name}_0"
    for i, (col, sql) in enumerate(D.DRAW_STEPS):
        step = sql.format(a="a", b="b", t="t", x="x", y="y")
        keep = "* EXCLUDE (x)" if col == "x" and i else "* EXCLUDE (y)" if col == "y" and i > 4 else "*"
        ctes += f",\n{name}_{i + 1} AS (SELECT {keep}, {step} AS {col} FROM {last})"
        last = f"{name}_{i + 1}"
    uni = D.DRAW_UNIFORM.format(x="x", y="y").replace("D)", ")").replace("D", "")
    return ctes + f",\n{name} AS (SELECT * EXCLUDE (a, b, h, x, y), {uni} AS {name}_u FROM {last})"


# ---------------------------------------------------------------------------
# D1, D2
# ---------------------------------------------------------------------------
@register("rank_by_score", _sql("", """SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  driver_id, round(score, 6) AS score, predicted_position FROM k8r"""))
def q_rank_by_score(spark: SparkSession, sf: str) -> DataFrame:
    p = k8_predictions(spark, sf)
    return p.select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                    r6("score").alias("score"), "predicted_position")


@register("softmax_group", _sql("", f"""SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  driver_id, round(e / sum(e) OVER (PARTITION BY season, round), 6) AS p_win
FROM (SELECT *, exp(u - max(u) OVER (PARTITION BY season, round)) AS e
      FROM (SELECT *, -coalesce(score, max(score) OVER (PARTITION BY season, round), 0.0) / {TEMPERATURE} AS u
            FROM k8) a) b"""))
def q_softmax_group(spark: SparkSession, sf: str) -> DataFrame:
    p = D.softmax_group(k8_scores(spark, sf), temperature=TEMPERATURE)
    return p.select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                    r6("p_win").alias("p_win"))


# ---------------------------------------------------------------------------
# D3, D4, D5
# ---------------------------------------------------------------------------
D3_CTE = HEAT_SQL + _draws_sql("k8f", str(SEED), "dr", ", t.t") + f""",
d3 AS (
  SELECT season, round, heat, driver_id, CAST(position AS BIGINT) AS position, count(*) AS draws
  FROM (SELECT *, row_number() OVER (PARTITION BY season, round, heat, t
               ORDER BY filled / {TEMPERATURE} + ln(-ln(dr_u)), driver_id) AS position FROM dr) r
  GROUP BY 1, 2, 3, 4, 5
)"""
HEAT_OUT = "CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, heat"


def heat_scores(spark: SparkSession, sf: str) -> DataFrame:
    """K8 scores by heat, written once: the draws, the dense grid and the comparisons read them many times."""
    return staged(with_heat(k8_scores(spark, sf)), "heat-scores")


def _d3(heats: DataFrame, dense: bool = False) -> DataFrame:
    return D.rank_distribution(heats, samples=SAMPLES, temperature=TEMPERATURE, seed=SEED,
                               group=HEAT, dense=dense)


def _heat_out(df: DataFrame, *extra) -> DataFrame:
    return df.select(big("season").alias("season"), big("round").alias("round"), "heat", *extra)


def _dist_out(d: DataFrame) -> DataFrame:
    return _heat_out(d, "driver_id", "position", "draws", r6("probability").alias("probability"))


@register("rank_distribution", _sql(D3_CTE, f"""SELECT {HEAT_OUT}, driver_id, position, draws,
  round(draws / {float(SAMPLES)}, 6) AS probability FROM d3"""))
def q_rank_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _dist_out(_d3(heat_scores(spark, sf)))


@register("dense_matrix", _sql(D3_CTE, f"""SELECT CAST(g.season AS BIGINT) AS season, CAST(g.round AS BIGINT) AS round, g.heat,
  g.driver_id, g.position, coalesce(c.draws, 0) AS draws, round(coalesce(c.draws, 0) / {float(SAMPLES)}, 6) AS probability
FROM (SELECT season, round, heat, driver_id, CAST(unnest(generate_series(1, n)) AS BIGINT) AS position FROM k8f) g
LEFT JOIN d3 c USING (season, round, heat, driver_id, position)"""))
def q_dense_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every (entity, position) of each heat, on the draws of D3."""
    return _dist_out(_d3(heat_scores(spark, sf), dense=True))


D4_CTE = HEAT_SQL + """,
k8d AS (
  SELECT k.*, coalesce(f.dnf_rate, 0.0) AS dnf_prob
  FROM k8f k LEFT JOIN (
    SELECT s.season, s.round, s.driver_id,
           CAST(sum(f.dnf) AS DOUBLE) / nullif(count(f.driver_id), 0) AS dnf_rate
    FROM sp s LEFT JOIN kf f ON f.driver_id = s.driver_id AND f.season = s.season AND f.round < s.round
    GROUP BY 1, 2, 3) f USING (season, round, driver_id)
)""" + _draws_sql("k8d", str(SEED), "dr", ", t.t") + _draws_sql("dr", f"{SEED}:out", "dw", "") + f""",
d4 AS (
  SELECT season, round, heat, driver_id, position, count(*) AS draws
  FROM (SELECT *, CASE WHEN dw_u < dnf_prob THEN 'DNF' ELSE CAST(row_number() OVER (
          PARTITION BY season, round, heat, t, dw_u < dnf_prob ORDER BY filled / {TEMPERATURE} + ln(-ln(dr_u)), driver_id)
          AS VARCHAR) END AS position FROM dw) r
  GROUP BY 1, 2, 3, 4, 5
)"""


def k8_with_dnf(spark: SparkSession, sf: str) -> DataFrame:
    """K8 scores plus a withdrawal probability = season-prior DNF rate (F6), 0 when unknown."""
    sp, facts = FT.baseline_inputs(spark, sf)
    rel = FT.reliability(sp.select("season", "round", "driver_id", "constructor_id"), facts)
    f3 = FT.entity_season_form(rel, facts)
    return f3.select("season", "round", "driver_id", "constructor_id", F.col("driver_q_avg_pos_season_prior").alias("score"),
                     F.coalesce(F.col("driver_season_dnf_rate_prior"), F.lit(0.0)).alias("dnf_prob"))


def heat_scores_dnf(spark: SparkSession, sf: str) -> DataFrame:
    """The same with withdrawal probabilities."""
    return staged(with_heat(k8_with_dnf(spark, sf)), "heat-scores-dnf")


def _d4(heats: DataFrame) -> DataFrame:
    return D.rank_distribution(heats, samples=SAMPLES, temperature=TEMPERATURE, seed=SEED,
                               group=HEAT, withdraw_prob="dnf_prob", dense=False)


@register("rank_distribution_dnf", _sql(D4_CTE, f"""SELECT {HEAT_OUT}, driver_id, position, draws,
  round(draws / {float(SAMPLES)}, 6) AS probability FROM d4"""))
def q_rank_distribution_dnf(spark: SparkSession, sf: str) -> DataFrame:
    return _dist_out(_d4(heat_scores_dnf(spark, sf)))


# ---------------------------------------------------------------------------
# D7 input gate
# ---------------------------------------------------------------------------
@register("input_gate", _sql("", """SELECT CAST(w.season AS BIGINT) AS season, CAST(w.round AS BIGINT) AS round,
  CAST(coalesce(f.feature_rows, 0) AS BIGINT) AS feature_rows,
  CAST(coalesce(f.required_values, 0) AS BIGINT) AS required_values,
  CASE WHEN coalesce(f.feature_rows, 0) = 0 THEN 'no_features'
       WHEN coalesce(f.required_values, 0) = 0 THEN 'no_qualifying_position' END AS reason,
  CAST(CASE WHEN coalesce(f.feature_rows, 0) > 0 AND coalesce(f.required_values, 0) > 0 THEN 1 ELSE 0 END
       AS BIGINT) AS ok
FROM k2 w LEFT JOIN (
  SELECT s.season, s.round, count(*) AS feature_rows, count(q.qualifying_position) AS required_values
  FROM sp s LEFT JOIN k1 q ON q.season = s.season AND q.round = s.round AND q.driver_id = s.driver_id
  GROUP BY 1, 2) f ON f.season = w.season AND f.round = w.round"""))
def q_input_gate(spark: SparkSession, sf: str) -> DataFrame:
    sp, _ = FT.baseline_inputs(spark, sf)
    k1 = K.results(spark, sf).select("season", "round", "driver_id", "qualifying_position")
    feats = sp.join(k1, ["season", "round", "driver_id"], "left")
    g = D.input_gate(feats, K.weekends(spark, sf))
    return g.select(big("season").alias("season"), big("round").alias("round"),
                    big("feature_rows").alias("feature_rows"), big("required_values").alias("required_values"),
                    "reason", big("ok").alias("ok"))


# ---------------------------------------------------------------------------
# V1 - V6
# ---------------------------------------------------------------------------
V4_CTE = """,
v4 AS (
  SELECT p.season, p.round,
         avg(abs(p.predicted_position - a.finish_position)) AS mae,
         CAST(sum(CASE WHEN p.predicted_position = a.finish_position THEN 1 ELSE 0 END) AS BIGINT) AS exact,
         CAST(sum(CASE WHEN p.predicted_position <= 1 AND a.finish_position <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS top1,
         CAST(sum(CASE WHEN p.predicted_position <= 3 AND a.finish_position <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS top3,
         CAST(sum(CASE WHEN p.predicted_position <= 5 AND a.finish_position <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS top5,
         CAST(count(*) AS BIGINT) AS n
  FROM k8r p
  LEFT JOIN k1 a ON a.season = p.season AND a.round = p.round AND a.driver_id = p.driver_id
  WHERE EXISTS (SELECT 1 FROM k1 x WHERE x.season = p.season AND x.round = p.round)
  GROUP BY 1, 2
)"""


V4Q_CTE = V4_CTE.replace("finish_position", "qualifying_position")


def _eval_top(spark: SparkSession, sf: str, actual_col: str = "finish_position") -> DataFrame:
    return V.eval_top(k8_predictions(spark, sf), K.results(spark, sf), actual_col=actual_col)


@register("eval_top", _sql(V4_CTE, """SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  round(mae, 6) AS mae, exact, top1, top3, top5, n FROM v4"""))
def q_eval_top(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(_eval_top(spark, sf), r6("mae").alias("mae"), "exact", "top1", "top3", "top5", "n")


@register("eval_top_quali", _sql(V4Q_CTE, """SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  round(mae, 6) AS mae, exact, top1, top3, top5, n FROM v4"""))
def q_eval_top_quali(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(_eval_top(spark, sf, "qualifying_position"), r6("mae").alias("mae"), "exact", "top1", "top3", "top5", "n")


@register("eval_range_summary", _sql(V4_CTE, """SELECT CAST(season AS BIGINT) AS season,
  CAST(count(*) AS BIGINT) AS rounds, round(avg(mae), 6) AS mae,
  round(CAST(sum(exact) AS DOUBLE) / sum(n), 6) AS exact_rate,
  round(CAST(sum(top1) AS DOUBLE) / (count(*) * 1), 6) AS top1_rate,
  round(CAST(sum(top3) AS DOUBLE) / (count(*) * 3), 6) AS top3_rate,
  round(CAST(sum(top5) AS DOUBLE) / (count(*) * 5), 6) AS top5_rate
FROM v4 GROUP BY 1"""))
def q_eval_range_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = V.eval_range_summary(_eval_top(spark, sf))
    return s.select(big("season").alias("season"), big("rounds").alias("rounds"), r6("mae").alias("mae"),
                    *[r6(c).alias(c) for c in ["exact_rate", "top1_rate", "top3_rate", "top5_rate"]])


# ---------------------------------------------------------------------------
# V1 - V3, V5: compare / evaluate against actual qualifying and race results
# ---------------------------------------------------------------------------
def _actual(spark: SparkSession, sf: str) -> DataFrame:
    return K.results(spark, sf)


def _keys(df: DataFrame, *extra) -> DataFrame:
    return df.select(big("season").alias("season"), big("round").alias("round"), *extra)


V1_CTE = """,
v1 AS (
  SELECT p.season, p.round, p.driver_id, p.predicted_position, a.qualifying_position AS actual_position,
         abs(p.predicted_position - a.qualifying_position) AS abs_error,
         coalesce(CAST(a.qualifying_position AS VARCHAR), 'NO_QUALI_RESULT') AS actual_text
  FROM k8r p LEFT JOIN k1 a ON a.season = p.season AND a.round = p.round AND a.driver_id = p.driver_id
)"""


V1R_CTE = V1_CTE.replace("qualifying_position", "finish_position").replace("NO_QUALI_RESULT", "NO_RACE_RESULT")
V1_OUT = """SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  driver_id, predicted_position, actual_position, abs_error, actual_text FROM v1"""
V1_SUM = """SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  round(avg(CASE WHEN actual_position IS NOT NULL THEN abs_error END), 6) AS mae,
  CAST(sum(CASE WHEN actual_position IS NOT NULL AND abs_error = 0 THEN 1 ELSE 0 END) AS BIGINT) AS exact,
  count(actual_position) AS valid, CAST(sum(CASE WHEN actual_position IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing
FROM v1 GROUP BY 1, 2"""
RACE = {"actual_col": "finish_position", "sentinel": "NO_RACE_RESULT"}


def _compare_top(spark: SparkSession, sf: str, **side: str) -> DataFrame:
    return V.compare_top(k8_predictions(spark, sf), _actual(spark, sf), **side)


def _top_out(d: DataFrame) -> DataFrame:
    return _keys(d, "driver_id", "predicted_position", "actual_position", "abs_error", "actual_text")


def _top_sum_out(d: DataFrame) -> DataFrame:
    return _keys(V.compare_top_summary(d), r6("mae").alias("mae"), "exact", "valid", "missing")


@register("compare_top", _sql(V1_CTE, V1_OUT))
def q_compare_top(spark: SparkSession, sf: str) -> DataFrame:
    return _top_out(_compare_top(spark, sf))


@register("compare_top_race", _sql(V1R_CTE, V1_OUT))
def q_compare_top_race(spark: SparkSession, sf: str) -> DataFrame:
    return _top_out(_compare_top(spark, sf, **RACE))


@register("compare_top_summary", _sql(V1_CTE, V1_SUM))
def q_compare_top_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _top_sum_out(_compare_top(spark, sf))


@register("compare_top_race_summary", _sql(V1R_CTE, V1_SUM))
def q_compare_top_race_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _top_sum_out(_compare_top(spark, sf, **RACE))


# hits: every predicted entity of a heat whose actual position is one of the heat's n (or DNF), drawn or not
V2_CTE = D3_CTE + f""",
v2 AS (
  SELECT k.season, k.round, k.heat, k.driver_id, a.qualifying_position AS actual_position, coalesce(d.draws, 0) AS draws
  FROM k8f k JOIN kh a USING (season, round, heat, driver_id)
  LEFT JOIN d3 d ON d.season = k.season AND d.round = k.round AND d.heat = k.heat AND d.driver_id = k.driver_id
                AND d.position = a.qualifying_position
  WHERE a.qualifying_position BETWEEN 1 AND k.n
)"""
V3_CTE = D4_CTE + """,
lab AS (
  SELECT k.season, k.round, k.heat, k.driver_id, k.n, a.driver_id IS NOT NULL AS known, a.finish_position,
         CASE WHEN coalesce(a.dnf, 0) = 1 OR a.finish_position IS NULL THEN 'DNF'
              ELSE CAST(a.finish_position AS VARCHAR) END AS actual_position
  FROM k8f k LEFT JOIN kh a USING (season, round, heat, driver_id)
),
v3 AS (
  SELECT l.*, coalesce(d.draws, 0) AS draws FROM lab l
  LEFT JOIN d4 d ON d.season = l.season AND d.round = l.round AND d.heat = l.heat AND d.driver_id = l.driver_id
                AND d.position = l.actual_position
  WHERE l.actual_position = 'DNF' OR l.finish_position BETWEEN 1 AND l.n
)"""
MEAN_P = f"round(CAST(sum(draws) AS DOUBLE) / (count(*) * {float(SAMPLES)}), 6) AS avg_p_actual"


def _detail_out(d: DataFrame) -> DataFrame:
    return _heat_out(d, "driver_id", "actual_position", r6("probability").alias("probability")) \
        .orderBy("season", "round", "heat", F.col("probability").desc(), "driver_id")


def _hits_out(d: DataFrame) -> DataFrame:
    return _heat_out(d, "hits", r6("avg_p_actual").alias("avg_p_actual"))


def _compare_dist(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    heats = heat_scores(spark, sf)
    return V.compare_dist(heats, _d3(heats), heat_actuals(spark, sf), SAMPLES, period=HEAT)


def _compare_dist_dnf(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    heats = heat_scores_dnf(spark, sf)
    return V.compare_dist(heats, _d4(heats), heat_actuals(spark, sf), SAMPLES, actual_col="finish_position",
                          period=HEAT, with_dnf=True)


@register("compare_dist_detail", _sql(V2_CTE, f"""SELECT {HEAT_OUT}, driver_id, actual_position,
  round(draws / {float(SAMPLES)}, 6) AS probability FROM v2"""))
def q_compare_dist_detail(spark: SparkSession, sf: str) -> DataFrame:
    """V2 detail rows, most probable first within a heat."""
    return _detail_out(_compare_dist(spark, sf)[0])


@register("compare_dist", _sql(V2_CTE, f"SELECT {HEAT_OUT}, count(*) AS hits, {MEAN_P} FROM v2 GROUP BY 1, 2, 3"))
def q_compare_dist(spark: SparkSession, sf: str) -> DataFrame:
    return _hits_out(_compare_dist(spark, sf)[1])


@register("eval_dist", _sql(V2_CTE, f"""SELECT CAST(k.season AS BIGINT) AS season, CAST(k.round AS BIGINT) AS round, k.heat,
  round(CAST(sum(v.draws) AS DOUBLE) / (nullif(count(v.driver_id), 0) * {float(SAMPLES)}), 6) AS avg_p_actual
FROM k8f k LEFT JOIN v2 v USING (season, round, heat, driver_id)
WHERE EXISTS (SELECT 1 FROM kh x WHERE x.season = k.season AND x.round = k.round AND x.heat = k.heat)
GROUP BY 1, 2, 3"""))
def q_eval_dist(spark: SparkSession, sf: str) -> DataFrame:
    heats = heat_scores(spark, sf)
    e = V.eval_dist(heats, _d3(heats), heat_actuals(spark, sf), SAMPLES, period=HEAT)
    return _heat_out(e, r6("avg_p_actual").alias("avg_p_actual"))


@register("compare_dist_dnf_detail", _sql(V3_CTE, f"""SELECT {HEAT_OUT}, driver_id, actual_position,
  round(draws / {float(SAMPLES)}, 6) AS probability FROM v3"""))
def q_compare_dist_dnf_detail(spark: SparkSession, sf: str) -> DataFrame:
    """V3 detail rows, most probable first within a heat."""
    return _detail_out(_compare_dist_dnf(spark, sf)[0])


@register("compare_dist_dnf", _sql(V3_CTE, f"SELECT {HEAT_OUT}, count(*) AS hits, {MEAN_P} FROM v3 GROUP BY 1, 2, 3"))
def q_compare_dist_dnf(spark: SparkSession, sf: str) -> DataFrame:
    return _hits_out(_compare_dist_dnf(spark, sf)[1])


@register("eval_dist_dnf", _sql(V3_CTE, f"""SELECT CAST(k.season AS BIGINT) AS season, CAST(k.round AS BIGINT) AS round, k.heat,
  round(CAST(sum(v.draws) AS DOUBLE) / (nullif(count(v.driver_id), 0) * {float(SAMPLES)}), 6) AS avg_p_actual
FROM k8f k LEFT JOIN (SELECT * FROM v3 WHERE known) v USING (season, round, heat, driver_id)
WHERE EXISTS (SELECT 1 FROM kh x WHERE x.season = k.season AND x.round = k.round AND x.heat = k.heat)
GROUP BY 1, 2, 3"""))
def q_eval_dist_dnf(spark: SparkSession, sf: str) -> DataFrame:
    heats = heat_scores_dnf(spark, sf)
    e = V.eval_dist(heats, _d4(heats), heat_actuals(spark, sf), SAMPLES, actual_col="finish_position", period=HEAT,
                    with_dnf=True)
    return _heat_out(e, r6("avg_p_actual").alias("avg_p_actual"))


@register("eval_range_dist", _sql(V2_CTE, f"""
, e AS (SELECT season, round, heat, CAST(sum(draws) AS DOUBLE) / (count(*) * {float(SAMPLES)}) AS p FROM v2 GROUP BY 1, 2, 3)
SELECT CAST(season AS BIGINT) AS season, round(avg(p), 6) AS avg_p_actual FROM e GROUP BY 1"""))
def q_eval_range_dist(spark: SparkSession, sf: str) -> DataFrame:
    """V6 with distributions: mean of the heats' mean probabilities, next to the order's scores."""
    heats = heat_scores(spark, sf)
    rounds = V.eval_dist(heats, _d3(heats), heat_actuals(spark, sf), SAMPLES, period=HEAT)
    s = V.eval_range_summary(_eval_top(spark, sf), rounds)
    return s.select(big("season").alias("season"), r6("avg_p_actual").alias("avg_p_actual"))


# ---------------------------------------------------------------------------
# Coverage, latest round, weekend lookup, availability
# ---------------------------------------------------------------------------
COV_CTE = """,
cov AS (
  SELECT coalesce(c.season, r.season) AS season, coalesce(c.n, 0) AS calendar_rounds,
         coalesce(r.n, 0) AS result_rounds
  FROM (SELECT season, count(DISTINCT round) AS n FROM k2 GROUP BY 1) c
  FULL OUTER JOIN (SELECT season, count(DISTINCT round) AS n FROM k1 GROUP BY 1) r ON c.season = r.season
)"""


@register("coverage", _sql(COV_CTE, """SELECT CAST(season AS BIGINT) AS season, calendar_rounds, result_rounds,
  CAST(CASE WHEN calendar_rounds > 0 AND result_rounds >= calendar_rounds THEN 1 ELSE 0 END AS BIGINT) AS complete
FROM cov"""))
def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = V.coverage(K.weekends(spark, sf), _actual(spark, sf))
    return c.select(big("season").alias("season"), "calendar_rounds", "result_rounds", big("complete").alias("complete"))


@register("coverage_summary", _sql(COV_CTE, """SELECT
  CAST((SELECT min(season) FROM cov WHERE result_rounds >= calendar_rounds AND calendar_rounds > 0) AS BIGINT) AS trained_from,
  CAST((SELECT max(season) FROM cov WHERE result_rounds >= calendar_rounds AND calendar_rounds > 0) AS BIGINT) AS trained_to,
  (SELECT count(*) FROM cov WHERE result_rounds >= calendar_rounds AND calendar_rounds > 0) AS complete_seasons,
  CAST(season AS BIGINT) AS current_season, result_rounds AS current_done, calendar_rounds AS current_total
FROM cov WHERE season = (SELECT max(season) FROM cov)"""))
def q_coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = V.coverage_summary(V.coverage(K.weekends(spark, sf), _actual(spark, sf)))
    return s.select(big("trained_from").alias("trained_from"), big("trained_to").alias("trained_to"),
                    "complete_seasons", big("current_season").alias("current_season"), "current_done",
                    "current_total")


@register("latest_round", with_carriers("""
, u AS (SELECT season, round FROM k1 UNION ALL SELECT season, round FROM k9 UNION ALL SELECT season, round FROM k4)
SELECT CAST(season AS BIGINT) AS season, CAST(max(round) AS BIGINT) AS round FROM u
WHERE season = (SELECT max(season) FROM u) GROUP BY 1""", "k1", "k4", "k9"))
def q_latest_round(spark: SparkSession, sf: str) -> DataFrame:
    """All four datasets: race, qualifying, sprint, practice."""
    k1 = _actual(spark, sf)
    l = V.latest_round([k1.where("finish_position IS NOT NULL"), k1.where("qualifying_position IS NOT NULL"),
                        K.sprint_results(spark, sf, k1), K.laps(spark, sf)])
    return l.select(big("season").alias("season"), big("round").alias("round"))


@register("weekend_info", with_carriers("""SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  weekend_id, race_date, sprint_date, CAST(sprint_date IS NOT NULL AS BIGINT) AS has_sprint
FROM k2 WHERE (season = 2000 AND round IN (4, 5)) OR season = 1999""", "k2"))
def q_weekend_info(spark: SparkSession, sf: str) -> DataFrame:
    wk = K.weekends(spark, sf)
    parts = [V.weekend_info(wk, 2000, 4), V.weekend_info(wk, 2000, 5), wk.where(F.col("season") == 1999)
             .withColumn("has_sprint", F.col("sprint_date").isNotNull().cast("int"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.select(big("season").alias("season"), big("round").alias("round"), "weekend_id", "race_date",
                    "sprint_date", big("has_sprint").alias("has_sprint"))


@register("availability_matrix", with_carriers("""
, u AS (SELECT DISTINCT season, round, 'practice' AS ds FROM k4
        UNION ALL SELECT DISTINCT season, round, 'race' FROM k1
        UNION ALL SELECT DISTINCT season, round, 'sprint' FROM k9)
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  count(CASE WHEN ds = 'practice' THEN 1 END) AS practice, count(CASE WHEN ds = 'race' THEN 1 END) AS race,
  count(CASE WHEN ds = 'sprint' THEN 1 END) AS sprint
FROM u GROUP BY 1, 2""", "k4", "k9"))
def q_availability_matrix(spark: SparkSession, sf: str) -> DataFrame:
    k1 = _actual(spark, sf)
    m = V.availability_matrix({"practice": K.laps(spark, sf), "race": k1,
                               "sprint": K.sprint_results(spark, sf, k1)})
    return m.select(big("season").alias("season"), big("round").alias("round"), "practice", "race", "sprint")


# ---------------------------------------------------------------------------
# Proper scores
# ---------------------------------------------------------------------------
def _brier_sql(name: str, table: str, drawn: str, happened: str) -> str:
    return f""", pk AS (
  SELECT season, round, heat, driver_id, sum(CASE WHEN {drawn} THEN draws ELSE 0 END) AS c FROM {table} GROUP BY 1, 2, 3, 4)
SELECT CAST(p.season AS BIGINT) AS season, CAST(p.round AS BIGINT) AS round, p.heat,
  round(CAST(sum(power(p.c - CASE WHEN {happened} THEN {SAMPLES} ELSE 0 END, 2)) AS DOUBLE)
        / (count(*) * {float(SAMPLES ** 2)}), 6) AS {name}
FROM pk p LEFT JOIN kh a USING (season, round, heat, driver_id) GROUP BY 1, 2, 3"""


def _brier_topk(spark: SparkSession, sf: str, k: int) -> DataFrame:
    b = V.brier_topk(_d3(heat_scores(spark, sf)), heat_actuals(spark, sf), k, SAMPLES, actual_col="qualifying_position", period=HEAT)
    return _heat_out(b, r6(f"brier_top{k}").alias(f"brier_top{k}"))


@register("brier_topk", _sql(D3_CTE, _brier_sql("brier_top3", "d3", "position <= 3", "a.qualifying_position <= 3")))
def q_brier_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _brier_topk(spark, sf, 3)


@register("brier_top10", _sql(D3_CTE, _brier_sql("brier_top10", "d3", "position <= 10", "a.qualifying_position <= 10")))
def q_brier_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _brier_topk(spark, sf, 10)


@register("brier_dnf", _sql(D4_CTE, _brier_sql("brier_dnf", "d4", "position = 'DNF'", "a.dnf = 1")))
def q_brier_dnf(spark: SparkSession, sf: str) -> DataFrame:
    b = V.brier_dnf(_d4(heat_scores_dnf(spark, sf)), heat_actuals(spark, sf), SAMPLES, period=HEAT)
    return _heat_out(b, r6("brier_dnf").alias("brier_dnf"))


@register("log_loss", _sql(D3_CTE, f""", pa AS (
  SELECT d.season, d.round, d.heat, d.driver_id,
         sum(CASE WHEN d.position = a.qualifying_position THEN d.draws ELSE 0 END) / {float(SAMPLES)} AS p
  FROM d3 d JOIN kh a USING (season, round, heat, driver_id) GROUP BY 1, 2, 3, 4)
SELECT {HEAT_OUT}, round(avg(-ln(greatest(p, 1e-15))), 6) AS log_loss, count(*) AS n
FROM pa GROUP BY 1, 2, 3"""))
def q_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    l = V.log_loss(_d3(heat_scores(spark, sf)), heat_actuals(spark, sf), actual_col="qualifying_position", period=HEAT)
    return _heat_out(l, r6("log_loss").alias("log_loss"), "n")


@register("rank_corr", _sql("", """, m AS (
  SELECT p.season, p.round, p.score, CAST(a.finish_position AS DOUBLE) AS a
  FROM k8 p JOIN k1 a ON a.season = p.season AND a.round = p.round AND a.driver_id = p.driver_id
  WHERE a.finish_position IS NOT NULL AND p.score IS NOT NULL),
r AS (
  SELECT season, round,
    rank() OVER (PARTITION BY season, round ORDER BY score)
      + (count(*) OVER (PARTITION BY season, round, score) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY season, round ORDER BY a)
      + (count(*) OVER (PARTITION BY season, round, a) - 1) / 2.0 AS rb
  FROM m)
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, round(corr(ra, rb), 6) AS spearman,
  count(*) AS n FROM r GROUP BY 1, 2"""))
def q_rank_corr(spark: SparkSession, sf: str) -> DataFrame:
    c = V.rank_corr(k8_scores(spark, sf), _actual(spark, sf))
    return _keys(c, r6("spearman").alias("spearman"), "n")
