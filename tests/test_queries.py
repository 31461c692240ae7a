"""Oracle, property and plan-shape tests on the smallest driver tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"

ORACLE_SET = [
    "asof_entity_season", "asof_group_season", "asof_teammate_delta", "asof_reliability", "asof_career",
    "asof_context_type", "asof_tenure", "features_baseline", "rank_by_score", "softmax_group", "eval_top",
    "eval_range_summary", "canon_results", "canon_quali", "page_combine_audit", "laptime_ms",
    "status_category", "entries_precedence", "resolve_ids", "longrun_summary", "practice_rank_gap_z",
    "train_frame_quali", "rescale_to_rate", "features_post_quali", "stream_update", "sink_partitioned",
    "compare_dist_dnf", "compare_dist", "eval_dist_dnf", "brier_dnf", "prediction_tags", "impute_apply", "rank_corr",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ORACLE_SET)
def test_oracle(spark, con, entry_mod, name):
    r = compare(spark, con, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name], SF)
    assert r["status"] == "match", r


def test_every_query_has_oracle_or_is_model(entry_mod):
    qs, sqls = entry_mod.queries(), entry_mod.oracle_sql()
    rows_only = {q for q in set(qs) - set(sqls) if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert rows_only <= {"model_position", "model_finish", "model_event", "calibrate_isotonic", "score_frame",
                         "model_roundtrip", "importance_topk", "importance_values", "backtest_range", "race_distribution", "jaccard_links"}


def test_leak_audit_has_no_mismatch(spark, entry_mod):
    rows = entry_mod.queries()["leak_audit"](spark, SF).collect()
    assert {r["prior_name"] for r in rows} == {"season_prior", "career_prior"}
    assert all(r["mismatches"] == 0 and r["checked_rows"] > 0 for r in rows)


def test_rank_distribution_rows_and_columns_sum_to_one(spark):
    from priorwise.operators.dist import rank_distribution

    scores = spark.createDataFrame(
        [(1, 1, i, float(s)) for i, s in enumerate([1.0, 1.5, 2.0, 4.0])]
        + [(1, 2, i, float(s)) for i, s in enumerate([3.0, 3.0, 0.5])], "season int, round int, driver_id long, score double")
    d = rank_distribution(scores, samples=400, temperature=1.0)
    by_entity = d.groupBy("season", "round", "driver_id").agg(F.sum("probability").alias("p")).collect()
    by_pos = d.groupBy("season", "round", "position").agg(F.sum("probability").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in by_entity)
    assert all(abs(r["p"] - 1) < 1e-9 for r in by_pos)
    # a better (lower) score never has a lower chance of first place here
    first = {r["driver_id"]: r["probability"] for r in d.where("round = 1 AND position = 1").collect()}
    assert first[0] >= first[1] >= first[2] >= first[3]


def test_rank_distribution_with_withdrawal(spark):
    from priorwise.operators.dist import rank_distribution

    scores = spark.createDataFrame([(1, 1, i, float(i), p) for i, p in enumerate([0.0, 0.5, 1.0])],
                                   "season int, round int, driver_id long, score double, dnf_prob double")
    d = rank_distribution(scores, samples=300, withdraw_prob="dnf_prob")
    rows = {(r["driver_id"], r["position"]): r["probability"] for r in d.collect()}
    assert rows[(0, "DNF")] == 0.0 and rows[(2, "DNF")] == 1.0
    for i in range(3):
        assert abs(sum(v for (e, _), v in rows.items() if e == i) - 1) < 1e-9


def test_laptime_edges(spark):
    from priorwise.functions.exprs import laptime_ms

    cases = [("1:2.5", 62500), ("59.123", 59123), ("1:23", None), ("", None), (" 1:23.4567 ", 83456),
             (None, None), ("1:23.", 83000)]
    df = spark.createDataFrame(cases, "t string, want long")
    got = df.select("want", laptime_ms("t").alias("ms")).collect()
    assert all(r["want"] == r["ms"] for r in got)


def test_status_edges(spark):
    from priorwise.functions.exprs import status_category

    cases = [("Finished", "CLASSIFIED"), ("+2 Laps", "CLASSIFIED"), ("Lapped", "CLASSIFIED"),
             ("Spun  off", "INCIDENT"), ("", "OTHER"), ("Powers", "MECHANICAL"), ("Disqualified", "DSQ"),
             ("Withdrew", "DNS"), ("Collision damage", "INCIDENT")]
    df = spark.createDataFrame(cases, "s string, want string")
    got = df.select("want", status_category("s").alias("c")).collect()
    assert all(r["want"] == r["c"] for r in got)
    sprint = spark.createDataFrame([("Lapped",), ("Retired",)], "s string") \
        .select(status_category("s", sprint=True).alias("c")).collect()
    assert [r["c"] for r in sprint] == ["OTHER", "OTHER"]


def test_trimmed_mean_small_and_large_groups(spark):
    from priorwise.operators.sessions import longrun_summary

    rows = [(1, i, float(v), False) for i, v in enumerate([10, 11, 12, 100])]          # n=4 -> plain mean
    rows += [(2, 10 + i, float(v), False) for i, v in enumerate([1, 2, 3, 4, 100])]    # n=5 -> k=1
    rows += [(2, 20, 5.0, True), (2, 21, None, False)]                                  # dropped
    df = spark.createDataFrame(rows, "driver_id long, event_id long, lap_time_ms double, in_out boolean")
    out = {r["driver_id"]: r for r in longrun_summary(df, keys=["driver_id"]).collect()}
    assert out[1]["practice_longrun_trimmed_ms"] == pytest.approx(33.25)
    assert out[2]["practice_longrun_trimmed_ms"] == pytest.approx(3.0)
    assert out[2]["practice_laps_count"] == 5


def test_plans_have_no_python_and_no_global_window(spark, entry_mod):
    for name in ["features_baseline", "rank_distribution", "eval_range_summary", "features_post_quali"]:
        df = entry_mod.queries()[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "SinglePartition" not in plan, name


def test_partition_filter_reaches_scan(spark, entry_mod, tmp_path):
    from priorwise.sources.tables import scan_partitioned, write_partitioned
    from priorwise.plans import carriers as K

    root = str(tmp_path / "k1")
    write_partitioned(K.results(spark, SF).select("season", "round", "driver_id"), root)
    df = scan_partitioned(spark, root, season=1996, round_=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "season" in plan and "PushedFilters" in plan
    assert {r["season"] for r in df.collect()} == {1996}


def test_undrawn_actual_counts_as_zero(spark):
    """An entity whose actual position was never drawn has probability 0 and is counted."""
    from priorwise.operators.evaluate import compare_dist, eval_dist

    scores = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 1, 3)], "season int, round int, driver_id long")
    counts = spark.createDataFrame([(1, 1, 1, 1, 10), (1, 1, 2, 2, 4), (1, 1, 2, 3, 6), (1, 1, 3, 3, 4), (1, 1, 3, 2, 6)],
                                   "season int, round int, driver_id long, position long, draws long")
    actual = spark.createDataFrame([(1, 1, 1, 3), (1, 1, 2, 2), (1, 1, 3, 9)],
                                   "season int, round int, driver_id long, qualifying_position long")
    detail, summary = compare_dist(scores, counts, actual, 10)
    assert {(r["driver_id"], r["probability"]) for r in detail.collect()} == {(1, 0.0), (2, 0.4)}  # 9 is outside 1..3
    assert [(r["hits"], r["avg_p_actual"]) for r in summary.collect()] == [(2, 0.2)]
    assert eval_dist(scores, counts, actual, 10).first()["avg_p_actual"] == 0.2
    labels = spark.createDataFrame([(1, 1, 1, None, 1), (1, 1, 2, 2, 0)],
                                   "season int, round int, driver_id long, finish_position long, dnf int")
    text = counts.withColumn("position", F.col("position").cast("string")) \
        .unionByName(spark.createDataFrame([(1, 1, 3, "DNF", 5)], "season int, round int, driver_id long, position string, draws long"))
    detail, summary = compare_dist(scores, text, labels, 10, actual_col="finish_position", with_dnf=True)
    assert {(r["driver_id"], r["actual_position"], r["draws"]) for r in detail.collect()} == {(1, "DNF", 0), (2, "2", 4), (3, "DNF", 5)}
    e = eval_dist(scores, text, labels, 10, actual_col="finish_position", with_dnf=True)
    assert e.first()["avg_p_actual"] == 0.2  # entity 3 has no actual row here


def test_draws_move_once(spark):
    """No exchange above the exploded draws but that of the counts; draws are uniform."""
    from priorwise.operators import dist as D

    scores = spark.createDataFrame([(1, r, i, float(i)) for r in range(3) for i in range(5)],
                                   "season int, round int, driver_id long, score double")
    d = D.rank_distribution(scores, samples=1000, dense=False)
    plan = d._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate explode(sequence(cast(__block")] if "Generate explode(sequence(cast(__block" in plan else \
        plan.split("Generate")[0]
    assert above.count("Exchange") == 1, plan
    base = spark.range(40).select(F.col("id").alias("driver_id"), F.lit(1).alias("season"))
    u = D.draw_constants(base, "42", ["season"], "driver_id", "k").crossJoin(spark.range(2000).withColumnRenamed("id", "t"))
    bins = D.uniform(u, "k", "t", "u").groupBy(F.floor(F.col("u") * 20).alias("bin")).count().collect()
    expected = 40 * 2000 / 20
    assert len(bins) == 20 and sum((r["count"] - expected) ** 2 / expected for r in bins) < 45  # chi-square, 19 degrees


def test_group_priors_keep_spine_rows_out_of_group_windows(spark):
    from priorwise.plans import features as FT

    sp, facts = FT.baseline_inputs(spark, SF)
    df = FT.group_season_form(sp.withColumn("only_on_spine", F.lit(1)), facts)
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "constructor_id" in line]
    assert windows and not any("only_on_spine" in line or "driver_id" in line for line in windows)


def test_latest_round_of_nothing(spark):
    from priorwise.operators.evaluate import latest_round

    none = spark.createDataFrame([], "season int, round int")
    assert [tuple(r) for r in latest_round([none, none]).collect()] == [(None, 1)]


def test_stream_restart_resumes(spark, tmp_path):
    """A second run takes only the new files; equal versions are resolved alike in any order."""
    from priorwise.streaming.update import stream_update

    incoming, root = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "season int, driver_id long, value long, version int"

    def put(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{incoming}/{name}")

    def run():
        out = stream_update(spark, incoming, root, ["season", "driver_id"], ["season"],
                            schema=spark.createDataFrame([], schema).schema)
        return {(r["season"], r["driver_id"]): r["value"] for r in out.collect()}

    put([(1, 1, 10, 1), (1, 2, 20, 1), (2, 1, 30, 1)], "a")
    assert run() == {(1, 1): 10, (1, 2): 20, (2, 1): 30}
    put([(1, 1, 11, 2), (1, 2, 5, 0), (2, 1, 31, 1)], "b")
    assert run() == {(1, 1): 11, (1, 2): 20, (2, 1): 31}
    batches = len(list((tmp_path / "table_checkpoint" / "commits").glob("[0-9]*")))
    assert run() == {(1, 1): 11, (1, 2): 20, (2, 1): 31}  # nothing new: no batch
    assert len(list((tmp_path / "table_checkpoint" / "commits").glob("[0-9]*"))) == batches == 2


def test_bad_snapshot_raises_in_the_scan(spark, tmp_path):
    from priorwise.sources.snapshot import SNAPSHOT_ERROR, read_snapshot

    folder = tmp_path / "snap" / "season=2000"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"MRData": {"total": "1", "RaceTable": {"Races": []}}}\n[1, 2]\n')
    with pytest.raises(Exception, match=SNAPSHOT_ERROR):
        read_snapshot(spark, str(tmp_path / "snap")).select("MRData.total").collect()
    whole = tmp_path / "whole" / "season=2001"
    whole.mkdir(parents=True)
    (whole / "a.json").write_text('{\n "MRData": {\n  "total": "7"}\n}')
    assert read_snapshot(spark, str(tmp_path / "whole"), multiline=True).first()["MRData"]["total"] == "7"


def test_seconds_and_path_keys(spark):
    from priorwise.functions.exprs import path_key, seconds_to_ms

    df = spark.createDataFrame([("a/season=2001/round=07/x", 1.5), ("a/b", None)], "p string, s double")
    got = df.select(path_key("p").alias("r"), path_key("p", "season").alias("y"), seconds_to_ms("s").alias("ms")).collect()
    assert [tuple(r) for r in got] == [(7, 2001, 1500.0), (None, None, None)]


def test_a_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from priorwise.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    fake = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)


def test_mapping_shapes(spark):
    from priorwise.sources.mapping import explode_mapping

    cfg = spark.sql("""SELECT map('2000-01', 'STREET') AS by_weekend_id, map('2000-02', 'PERMANENT') AS weekend_id,
                       map('2000', map('3', 'STREET', 'x', 'OTHER')) AS by_season_round""")
    assert [tuple(r) for r in explode_mapping(cfg, "by_weekend_id").collect()] == [("2000-01", "STREET")]
    assert [tuple(r) for r in explode_mapping(cfg, "weekend_id").collect()] == [("2000-02", "PERMANENT")]
    assert {tuple(r) for r in explode_mapping(cfg, "by_season_round").collect()} == {(2000, 3, "STREET"), (2000, None, "OTHER")}
    assert explode_mapping(cfg, "by_moon").count() == 0
