"""Properties of the model path, with few trees: the frames, calibration, registry and names do not depend on them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from priorwise.operators import train as M
from priorwise.plans import queries_model as QM

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few_trees():
    with pytest.MonkeyPatch.context() as patch:
        reg, cls = M.position_regressor, M.event_classifier
        patch.setattr(M, "position_regressor", lambda label, trees=500, **kw: reg(label, trees=3, **kw))
        patch.setattr(M, "event_classifier", lambda label, trees=400, **kw: cls(label, trees=3, **kw))
        yield


def test_full_size_models_by_default(spark):
    assert M.position_regressor("y").getMaxIter() == 500 and M.event_classifier("y").getMaxIter() == 400


def test_race_scores(spark, few_trees):
    rows = QM.race_scores(spark, SF).collect()
    base = QM.event_model(spark, SF, "train").meta["base_rate"]
    assert rows and {(r["season"], r["round"]) for r in rows} == {(2000, m) for m in range(7, 13)} | {(2001, m) for m in range(1, 9)}
    assert all(0 <= r[c] <= 1 for r in rows for c in ("p", "p_cal", "dnf_prob"))
    ordered = sorted(rows, key=lambda r: r["p"])
    assert all(a["p_cal"] <= b["p_cal"] + 1e-12 for a, b in zip(ordered, ordered[1:]))  # isotonic
    for at in {(r["season"], r["round"]) for r in rows}:
        field = [r for r in rows if (r["season"], r["round"]) == at]
        if all(0 < r["dnf_prob"] < 1 for r in field):  # nothing clipped
            assert sum(r["dnf_prob"] for r in field) / len(field) == pytest.approx(base)


def test_registry_finds_and_reloads(spark, few_trees):
    artifact = QM.quali_model(spark, SF)
    registry = QM.registry_of(spark, SF)
    assert registry.load("quali", 1900, 1) is None
    again = registry.load_or_train("quali", *QM.AS_OF, lambda: pytest.fail("it is there"), artifact.meta["knows"])
    rows = QM._scoring_rows(spark, SF)
    a = {(r["season"], r["round"], r["driver_id"]): r["score"] for r in QM.position_scores(rows, artifact).collect()}
    b = {(r["season"], r["round"], r["driver_id"]): r["score"] for r in QM.position_scores(rows, again).collect()}
    assert a == b and len(a) == rows.count()
    # columns that are absent at scoring time are as missing, unseen categories and extra columns do no harm
    short = rows.drop("track_type", "driver_q_avg_pos_career_prior").withColumn("weekend_id", F.lit("new")).withColumn("more", F.lit(1))
    assert QM.position_scores(short, artifact).count() == len(a)


def test_race_scores_see_the_qualifying_position(spark, few_trees):
    artifact = QM.finish_model(spark, SF)
    assert "qualifying_position" in artifact.meta["numeric"] and "qualifying_position" not in QM.quali_model(spark, SF).meta["numeric"]
    rows = QM._race_rows(spark, SF)
    a, b = ({(r["season"], r["round"], r["driver_id"]): r["score"] for r in QM.position_scores(x, artifact).collect()}
            for x in (rows, rows.withColumn("qualifying_position", F.lit(1).cast("bigint"))))
    assert a.keys() == b.keys() and a != b


def test_distributions_are_drawn_from_model_scores(spark, few_trees):
    drawn = QM.q_race_distribution(spark, SF)
    rows = drawn.groupBy("season", "round", "driver_id").agg(F.sum("probability").alias("p"),
                                                             F.sum(F.when(F.col("position") == "DNF", F.col("probability")).otherwise(0.0)).alias("out")).collect()
    scores = {(r["season"], r["round"], r["driver_id"]): r for r in QM.race_scores(spark, SF).collect()}
    assert len(rows) == len(scores)
    for r in rows:
        want = scores[r["season"], r["round"], r["driver_id"]]["dnf_prob"]
        assert r["p"] == pytest.approx(1) and abs(r["out"] - want) < 5 * (0.25 / 5000) ** 0.5


def test_backtest_replays_versions(spark, few_trees):
    from priorwise.plans.queries_io import BACKTEST, q_backtest_range

    rows = {(r["stage"], r["season"]): r for r in q_backtest_range(spark, SF).collect()}
    assert set(rows) == {(s, y) for s in ("quali", "race") for y in (2000, 2001)}
    assert all(r["rounds"] > 0 and r["mae"] >= 0 for r in rows.values())
    registry = QM.registry_of(spark, SF)
    seen = {p: QM.quali_model(spark, SF, p).meta["knows"] for p in BACKTEST}
    assert len(set(seen.values())) == 2 and all(registry.load("quali", *p, k) is not None for p, k in seen.items())


def test_constant_predictor(spark, few_trees):
    from priorwise.sources.models import Artifact

    rows = QM._scoring_rows(spark, SF)
    registry = QM.registry_of(spark, SF)
    registry.save(Artifact(None, {"base_rate": 1.0}), "always", 2000, 1)
    assert {r["p"] for r in QM.event_scores(rows, registry.load("always", 2000, 1)).collect()} == {1.0}


def test_importance_names(spark, few_trees):
    artifact = QM.quali_model(spark, SF)
    rows = QM.prepared(QM._scoring_rows(spark, SF), artifact)
    names = M.feature_names(artifact.model, rows)
    assert names[:len(artifact.meta["numeric"])] == artifact.meta["numeric"] and len(set(names)) == len(names)
    assert {n.split("=")[0] for n in names[len(artifact.meta["numeric"]):]} == set(QM.MODEL_CATEGORICAL)
    top = M.importance_topk(artifact.model, 5, rows).collect()
    values = QM.q_importance_values(spark, SF)
    assert {r["feature"] for r in values.select("feature").distinct().collect()} == {r["feature"] for r in top}
    assert values.count() == 5 * rows.count()
