"""Registered queries for partitioned scans and sinks (S3-S11) and the
update loop (U1-U3). Tables are written under the shared checkpoint folder
and read back; the oracle states what the read-back must contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from priorwise.operators import canon as C
from priorwise.operators import evaluate as V
from priorwise.plans import carriers as K
from priorwise.plans import snapshots as SN
from priorwise.plans.carriers import with_carriers
from priorwise.operators.dist import parse_tags
from priorwise.plans.queries_score import D3_CTE, K8_SQL, V4_CTE, _d3, heat_scores, k8_predictions
from priorwise.plans.queries_asof import SQL_SP
from priorwise.plans.registry import big, r6, register
from priorwise.session import scratch_path
from priorwise.sources import store as ST
from priorwise.sources import tables as T
from priorwise.sources.snapshot import read_snapshot
from priorwise.streaming.update import stream_update

K1_OUT = "CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id, qualifying_position"
SPLIT_SEASON = 1998


def _k1(spark: SparkSession, sf: str) -> DataFrame:
    return K.results(spark, sf).select("season", "round", "driver_id", "qualifying_position")


def _k1_out(df: DataFrame) -> DataFrame:
    return df.select(big("season").alias("season"), big("round").alias("round"), "driver_id", "qualifying_position")


@register("scan_partitioned", with_carriers(f"SELECT {K1_OUT} FROM k1 WHERE season <= {SPLIT_SEASON}", "k1"))
def q_scan_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "k1_by_season")
    T.write_partitioned(_k1(spark, sf), root)
    return _k1_out(T.scan_partitioned(spark, root, season_max=SPLIT_SEASON))


@register("scan_optional", with_carriers(f"SELECT {K1_OUT} FROM k1", "k1"))
def q_scan_optional(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "k1_optional")
    T.write_partitioned(_k1(spark, sf), root)
    schema = StructType([StructField("round", LongType()), StructField("driver_id", LongType()),
                         StructField("qualifying_position", LongType()), StructField("season", LongType())])
    missing = T.scan_optional(spark, scratch_path(spark, "never_written"), schema)
    present = T.scan_optional(spark, root, schema)
    return _k1_out(missing.unionByName(present))


@register("sink_partitioned", with_carriers(f"""SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  driver_id, qualifying_position + CASE WHEN season > {SPLIT_SEASON} THEN 1000 ELSE 0 END AS qualifying_position
FROM k1""", "k1"))
def q_sink_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "k1_sink")
    k1 = _k1(spark, sf)
    T.write_partitioned(k1.where(F.col("season") <= SPLIT_SEASON), root, overwrite=True)
    # second run, overwrite=False: existing seasons stay untouched, new seasons are added
    T.write_partitioned(k1.withColumn("qualifying_position", F.col("qualifying_position") + 1000), root,
                        overwrite=False)
    return _k1_out(spark.read.parquet(root))


@register("union_sessions", with_carriers("""
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, session_type, driver_id,
       best_lap_time_ms, CASE WHEN session_type = 'FP1' THEN position END AS position,
       CASE WHEN session_type = 'FP3' THEN 'soft' END AS tyre
FROM k4s""", "k4s"))
def q_union_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = K.session_results(spark, sf)
    base = s.select(big("season").alias("season"), big("round").alias("round"), "session_type", "driver_id",
                    "best_lap_time_ms", "position")
    fp1 = base.where(F.col("session_type") == "FP1")
    fp2 = base.where(F.col("session_type") == "FP2").drop("position")
    fp3 = base.where(F.col("session_type") == "FP3").drop("position").withColumn("tyre", F.lit("soft"))
    root, frames = scratch_path(spark, "sessions"), []
    for name, frame in (("FP1", fp1), ("FP2", fp2), ("FP3", fp3)):
        frame.write.parquet(f"{root}/{name}")
        frames.append(spark.read.parquet(f"{root}/{name}"))
    return T.union_sessions(frames).select("season", "round", "session_type", "driver_id",
                                                    "best_lap_time_ms", "position", "tyre")


def _score_sql(ctes: str, select: str, *extra: str) -> str:
    return with_carriers(SQL_SP + K8_SQL + ctes + "\n" + select, "k1", "k2", "k3", *extra)


@register("prediction_store", _score_sql("", """SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  'post_practice' AS stage, 'quali_top' AS kind, driver_id, predicted_position, round(score, 6) AS score FROM k8r"""))
def q_prediction_store(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "predictions")
    p = k8_predictions(spark, sf).select("season", "round", "driver_id", "predicted_position",
                                         r6("score").alias("score"))
    ST.store_predictions(p, root, stage="post_practice", kind="quali_top", metadata={"tags": "top"})
    back = ST.read_predictions(spark, root, stage="post_practice", kind="quali_top")
    return back.select(big("season").alias("season"), big("round").alias("round"), "stage", "kind", "driver_id",
                       "predicted_position", "score")


@register("prediction_tags", _score_sql(D3_CTE, """
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, 'quali_dist' AS kind, count(*) AS rows FROM d3 GROUP BY 1, 2
UNION ALL SELECT CAST(season AS BIGINT), CAST(round AS BIGINT), 'quali_top', count(*) FROM k8r GROUP BY 1, 2"""))
def q_prediction_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The tags of a run say which outputs it stores: the order, the distribution, or both."""
    root = scratch_path(spark, "tagged_predictions")
    outputs = {"top": lambda: k8_predictions(spark, sf).select("season", "round", "driver_id", "predicted_position"),
               "dist": lambda: _d3(heat_scores(spark, sf)).select("season", "round", "heat", "driver_id", "position", "draws")}
    for tag in sorted(parse_tags(" Dist,top ")):
        ST.store_predictions(outputs[tag](), root, stage="post_practice", kind=f"quali_{tag}", metadata={"tags": tag})
    back = spark.read.option("mergeSchema", True).parquet(root)
    return back.groupBy(big("season").alias("season"), big("round").alias("round"), "kind").agg(F.count(F.lit(1)).alias("rows"))


@register("evaluation_sink", _score_sql(V4_CTE, """SELECT CAST(season AS BIGINT) AS season,
  CAST(round AS BIGINT) AS round, round(mae, 6) AS mae, exact, top1, top3, top5, n FROM v4"""))
def q_evaluation_sink(spark: SparkSession, sf: str) -> DataFrame:
    from priorwise.plans.queries_score import _eval_top

    e = _eval_top(spark, sf).select(big("season").alias("season"), big("round").alias("round"), r6("mae").alias("mae"),
                                    "exact", "top1", "top3", "top5", "n")
    root = scratch_path(spark, "evaluation")
    e.write.parquet(f"{root}/staged")  # evaluated once for all writes
    e = spark.read.parquet(f"{root}/staged")
    ST.save_evaluation(e, V.eval_range_summary(e), f"{root}/quali_top.parquet")
    ST.save_evaluation(e, V.eval_range_summary(e), f"{root}/quali_top.csv")
    both = spark.read.parquet(f"{root}/quali_top.parquet")
    text = spark.read.schema(both.schema).option("header", True).csv(f"{root}/quali_top.csv")
    return both.intersect(text)  # the CSV says the same


@register("only_missing_load", with_carriers("""SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  session_type, driver_id FROM k4s WHERE round > 6""", "k4s"))
def q_only_missing_load(spark: SparkSession, sf: str) -> DataFrame:
    s = K.session_results(spark, sf)
    existing = s.where(F.col("round") <= 6)
    out = T.only_missing(s, existing, ["season", "round", "session_type"])
    return out.select(big("season").alias("season"), big("round").alias("round"), "session_type", "driver_id")


@register("preview_topn", _score_sql("", """SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
  driver_id, round(score, 6) AS score FROM k8 ORDER BY score NULLS LAST, season, round, driver_id LIMIT 20"""))
def q_preview_topn(spark: SparkSession, sf: str) -> DataFrame:
    from priorwise.plans.queries_score import k8_scores

    s = k8_scores(spark, sf).select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                                    r6("score").alias("score"))
    return T.preview_topn(s, [F.col("score").asc_nulls_last(), F.col("season"), F.col("round"), F.col("driver_id")], 20)


@register("mapping_explode", with_carriers("""SELECT CAST(w.season AS BIGINT) AS season,
  CAST(w.round AS BIGINT) AS round, t.track_type FROM k2 w JOIN k2_tt t ON t.circuit_id = w.circuit_id""", "k2"))
def q_mapping_explode(spark: SparkSession, sf: str) -> DataFrame:
    from priorwise.sources.mapping import explode_mapping

    k2 = K.weekends(spark, sf).join(K.track_types(spark), "circuit_id")
    # the by_season_round shape: {season: {round: type}} as nested maps of text keys
    nested = k2.groupBy(F.col("season").cast("string").alias("season")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("round").cast("string"), F.col("track_type"))))
        .alias("by_round"))
    cfg = nested.agg(F.map_from_entries(F.collect_list(F.struct("season", "by_round"))).alias("by_season_round"))
    out = explode_mapping(cfg, "by_season_round")
    return out.select(big("season").alias("season"), big("round").alias("round"), "track_type")


# ---------------------------------------------------------------------------
# U1 / U2 / U3
# ---------------------------------------------------------------------------
UPDATE_SEASON = 2001


@register("update_season", with_carriers(f"""
SELECT CAST(season AS BIGINT) AS season, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(finish_position) AS BIGINT) AS classified
FROM (SELECT f.* FROM k1 f
      WHERE (f.driver_id + f.round) % {SN.EMPTY_DRIVER_MOD} <> 0
        AND (f.driver_id + f.round) % {SN.EMPTY_CONSTRUCTOR_MOD} <> 0) t
GROUP BY 1""", "k1"))
def q_update_season(spark: SparkSession, sf: str) -> DataFrame:
    snap = read_snapshot(spark, f"{SN.ensure_snapshots(spark, sf)}/results")
    canon = C.canon_results(snap).drop("source_path", "offset", "race_pos", "res_pos")
    root = scratch_path(spark, "canonical_results_race")
    # first build: a stale copy of the update season (half its rows)
    stale = canon.where((F.col("season") != UPDATE_SEASON) | (F.col("round") <= 4))
    T.write_partitioned(stale, root)
    # update: re-ingest that season and rewrite only its partition (dynamic overwrite)
    T.write_partitioned(canon.where(F.col("season") == UPDATE_SEASON), root, overwrite=True)
    back = spark.read.parquet(root)
    return back.groupBy(big("season").alias("season")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("finish_position").alias("classified"))


@register("stream_update", with_carriers("""
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id,
       qualifying_position + CASE WHEN round % 2 = 0 THEN 100 ELSE 0 END AS qualifying_position
FROM k1""", "k1"))
def q_stream_update(spark: SparkSession, sf: str) -> DataFrame:
    k1 = _k1(spark, sf).select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                               "qualifying_position")
    incoming = scratch_path(spark, "incoming_results")
    table_root = scratch_path(spark, "streamed_results")
    # batch 1: every row; batch 2: a correction of the even rounds (newer version wins)
    k1.withColumn("version", F.lit(1)).write.parquet(f"{incoming}/batch=1")
    (k1.where(F.col("round") % 2 == 0)
       .withColumn("qualifying_position", F.col("qualifying_position") + 100)
       .withColumn("version", F.lit(2)).write.parquet(f"{incoming}/batch=2"))
    out = stream_update(spark, incoming, table_root, keys=["season", "round", "driver_id"],
                        partition_cols=["season", "round"], version_col="version")
    return out.select(big("season").alias("season"), big("round").alias("round"), "driver_id",
                      "qualifying_position")


#: As-of points of the models that a backtest replays; each scores the rounds from its point to the next.
BACKTEST = [(2000, 7), (2001, 1)]


@register("backtest_range")
def q_backtest_range(spark: SparkSession, sf: str) -> DataFrame:
    """U3 with the real models: qualifying and race replayed by versions fitted at two points, stored, then V4/V6 by season and stage."""
    from priorwise.operators.dist import rank_by_score
    from priorwise.operators.replay import assign_versions, walk_forward
    from priorwise.plans import queries_model as QM

    actual = K.results(spark, sf).withColumns({"season": big("season"), "round": big("round")})
    # the tables are stored before the fits, which share them; the tables do not change between versions, so no fit waits for another's scores
    stages = [("quali", QM.features_post_practice(spark, sf), QM.quali_model, "qualifying_position"),
              ("race", QM.features_post_quali(spark, sf), QM.finish_model, "finish_position")]
    due = [(stage, tuple(r), model) for stage, frame, model, _ in stages
           for r in assign_versions(frame, BACKTEST).select("model_season", "model_round").distinct().collect()]  # one row a version
    fits = QM.side_by_side(*[lambda model=model, point=point: model(spark, sf, point) for _, point, model in due]) if due else []
    fitted = {(stage, point): artifact for (stage, point, _), artifact in zip(due, fits)}
    out = None
    for stage, frame, _, col in stages:

        def score(artifact, due, frame=frame):
            rows = QM.stage_frame(frame.join(due, ["season", "round"], "left_semi"), 2_000)  # few bytes but hundreds of trees a row: dealt over all cores
            return rank_by_score(QM.position_scores(rows, artifact))

        stored = walk_forward(frame, BACKTEST, lambda point, stage=stage: fitted[stage, point], score,
                              scratch_path(spark, f"backtest-{stage}"), stage, f"{stage}_top")
        found = stored.select(big("season").alias("season"), big("round").alias("round"), "driver_id", "predicted_position")
        s = V.eval_range_summary(V.eval_top(found, actual, actual_col=col)).withColumn("stage", F.lit(stage))
        out = s if out is None else out.unionByName(s)
    return out
