"""The trees grown by the tasks of one stage are those that Spark's own estimators fit, however many tasks grow them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from priorwise.operators import boost as B
from priorwise.operators import train as M

NUMERIC = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    """Columns that say the same, equal values, one-hot codes of few rows and weights: many splits gain the same."""
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 6))
    x[:, 3], x[:, 4], x[:, 5] = x[:, 1], r.integers(0, 5, 900), np.round(x[:, 0], 1)
    c1, c2 = r.integers(0, 30, 900), r.integers(0, 3, 900)
    y = 2 * x[:, 0] + np.sin(3 * x[:, 1]) + c1 % 7 * 0.3 + x[:, 4] + 0.3 * r.normal(size=900)
    frame = pd.DataFrame(x, columns=NUMERIC).assign(c1=c1.astype(str), c2=c2.astype(str), y=y, out=(y > 2).astype(float), wt=1 + 0.1 * r.integers(0, 6, 900))
    return spark.createDataFrame(frame).coalesce(1).cache()


def spark_fits(pipe, rows):
    """The pipeline with Spark's estimator in place of ours."""
    *before, last = pipe.getStages()
    return pipe.setStages([*before, last.settings]).fit(rows)


@pytest.mark.parametrize("made", [
    lambda: M.position_regressor("y", trees=4), lambda: M.position_regressor("y", trees=4, weight="wt", min_instances=5),
    lambda: M.event_classifier("out", trees=4, weight="wt")], ids=["plain", "weighted", "event"])
def test_trees_are_those_of_spark(spark, rows, made):
    here = M.feature_pipeline(NUMERIC, ["c1", "c2"], made()).fit(rows).stages[-1]
    there = spark_fits(M.feature_pipeline(NUMERIC, ["c1", "c2"], made()), rows).stages[-1]
    assert type(here) is type(there) and here.treeWeights == there.treeWeights
    assert here.toDebugString.split("\n")[1:] == there.toDebugString.split("\n")[1:]
    assert np.allclose(here.featureImportances.toArray(), there.featureImportances.toArray(), atol=1e-12)


def test_a_fit_starts_no_job_for_a_tree(spark, rows):
    def jobs(trees: int) -> int:
        name = f"fit-of-{trees}"
        spark.sparkContext.setJobGroup(name, name)
        M.feature_pipeline(NUMERIC, ["c1"], M.position_regressor("y", trees=trees)).fit(rows)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs(12) == jobs(2) > 0


def test_several_tasks_grow_the_same_trees(spark, rows, monkeypatch):
    """With all rows in each tree the draws do not depend on the tasks, so neither do the trees; in large nodes no two splits part the rows alike."""
    apart = rows.select("x0", "x1", "x2", "c1", "c2", "y")
    fit = lambda: M.feature_pipeline(NUMERIC[:3], ["c1", "c2"], M.position_regressor("y", trees=5, min_instances=20).setSubsamplingRate(1.0)).fit(apart)
    one = fit()
    monkeypatch.setattr(B, "ROWS", 300)
    assert B.task_count(spark, 900, "/tmp") == 4
    many = fit()
    a, b = ([r["prediction"] for r in m.transform(apart).collect()] for m in (one, many))
    assert np.allclose(a, b, rtol=1e-9) and one.stages[-1].totalNumNodes == many.stages[-1].totalNumNodes
    drawn = M.feature_pipeline(NUMERIC[:3], ["c1", "c2"], M.position_regressor("y", trees=5)).fit(apart).transform(apart)
    left = np.array([(r["prediction"], r["y"]) for r in drawn.select("prediction", "y").collect()])
    assert ((left[:, 0] - left[:, 1]) ** 2).mean() < 0.7 * left[:, 1].var()


def test_one_task_where_tasks_cannot_meet(spark):
    assert B.task_count(spark, 10 ** 6, "viewfs://store/models") == 1 and B.task_count(spark, 100, "/tmp") == 1


def test_generators_are_those_of_java(spark):
    jvm = spark._jvm
    for seed in (0, 42, -5):
        there, here = jvm.org.apache.spark.util.random.XORShiftRandom(seed), B.xorshift_doubles([seed, 7], 9)[0]
        assert [there.nextDouble() for _ in range(9)] == here.tolist()
        longs, mine = jvm.java.util.Random(seed), B.java_longs(seed)
        assert [longs.nextLong() % 2 ** 64 for _ in range(5)] == [next(mine) for _ in range(5)]
    x = [0.0, 1e-9, -1e-12, 0.3, -0.34, 0.35, 1.03, 1.05, -1.05, 5.5, -17.25, 709.0, -700.0, 710.0, -800.0]
    assert B.java_exp(np.array(x)).tolist() == [jvm.java.lang.StrictMath.exp(v) for v in x]


def test_no_rows_and_no_labels_are_errors(spark, rows):
    with pytest.raises(ValueError, match="no rows"):
        M.feature_pipeline(NUMERIC, [], M.position_regressor("y", trees=2)).fit(rows.where("x0 > 99"))
    with pytest.raises(Exception, match="label is missing"):
        M.feature_pipeline(NUMERIC, [], M.position_regressor("y", trees=2)).fit(rows.selectExpr("*", "if(x4 = 1, null, y) as z").drop("y").withColumnRenamed("z", "y"))
