"""Steps that must not grow faster than their input: what leaves a task, and equal results whatever the split."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from priorwise.operators import dist as D


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _same(a, b) -> bool:
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def _scores(spark):
    rows = [(1, r, d, None if d == 3 else (d * 7 % 5) / 2.0, d % 4 / 4.0) for r in (1, 2) for d in range(23 if r == 1 else 2)]
    return spark.createDataFrame(rows + [(1, 2, 1, 9.0, None)], "season int, round int, driver_id long, score double, w double")


def test_uniforms_in_tasks_are_those_of_the_sql_steps(spark):
    base = spark.createDataFrame([(7, d) for d in range(40)], "season int, driver_id long")
    k = D.draw_constants(base, "42", ["season"], "driver_id", "k")
    told = {(r["driver_id"], r["t"]): r["u"] for r in D.uniform(k.crossJoin(spark.range(60).withColumnRenamed("id", "t")), "k", "t", "u").collect()}
    rows = k.collect()
    u = D.uniforms(np.array([r["ka"] for r in rows]), np.array([r["kb"] for r in rows]), np.arange(60))
    assert {(r["driver_id"], t): u[t, i] for i, r in enumerate(rows) for t in range(60)} == told


def test_draws_do_not_become_rows(spark):
    """Positions equal those of a window over one row a draw, without that window."""
    for withdraw in (None, "w"):
        df = D.rank_distribution(_scores(spark), samples=90, withdraw_prob=withdraw, dense=False)
        assert "Window" not in _plan(df)
        group = ["season", "round"]
        rows = D.draw_constants(D.fill_scores(_scores(spark)), "42", group, "driver_id", "k")
        rows = D.draw_constants(rows, "42:out", group, "driver_id", "w_").crossJoin(spark.range(90).withColumnRenamed("id", "t"))
        rows = D.uniform(D.uniform(rows, "k", "t", "u"), "w_", "t", "v").withColumn("key", F.col("score") + F.log(-F.log("u")))
        out = F.col("v") < F.coalesce(F.col("w"), F.lit(0.0)) if withdraw else F.lit(False)
        place = F.row_number().over(Window.partitionBy(*group, "t", "out").orderBy("key", "driver_id"))
        place = F.when(F.col("out"), "DNF").otherwise(place.cast("string")) if withdraw else place.cast("bigint")
        told = rows.withColumn("out", out).withColumn("position", place).groupBy(*group, "driver_id", "position").agg(F.count("*").alias("draws"))
        assert _same(df.drop("probability"), told)


def test_blocks_of_any_size_count_alike(spark):
    for withdraw in (None, "w"):
        whole = D.rank_distribution(_scores(spark), samples=60, withdraw_prob=withdraw)
        for cells in (1, 50, 300):
            assert _same(D.rank_distribution(_scores(spark), samples=60, withdraw_prob=withdraw, cells=cells), whole)


def test_small_fields_are_ranked_without_sorting(monkeypatch):
    """Places by pairs and by sorting are alike, with ties, withdrawals and infinite keys; only large fields and NaN are sorted."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 20, D.FEW):
        key = rng.integers(0, 6, (n, 300)).astype(float)
        key[0, :50] = np.inf
        for stays in (None, rng.random((n, 300)) < 0.7):
            with monkeypatch.context() as patch:
                patch.setattr(D, "FEW", 0)
                told = D._places(key, stays)
            with monkeypatch.context() as patch:
                patch.setattr(np, "argsort", None)
                assert (D._places(key, stays) == told).all()
            held = np.ones(key.shape, bool) if stays is None else stays
            for t in range(0, 300, 37):
                inside = [i for i in sorted(range(n), key=lambda i: (key[i, t], i)) if held[i, t]]
                assert [int(p) for p in told[:, t]] == [inside.index(i) + 1 if held[i, t] else 0 for i in range(n)]
    assert D._places(np.array([[np.nan], [1.0]]), None).tolist() == [[2], [1]]


def test_results_rows_stay_narrow_and_normalise_once(spark, tmp_path):
    """A result carries its race without the race's arrays, and its status is normalised once."""
    import json

    from pyspark.sql.types import ArrayType

    from priorwise.operators import canon as C
    from priorwise.sources import snapshot as S

    row = {"position": "1", "grid": "2", "Driver": {"driverId": "a"}, "Constructor": {"constructorId": "b"}}
    race = {"round": "3", "raceName": "R", "date": "2000-01-02", "Circuit": {"circuitId": "c"},
            "Results": [{**row, "status": s} for s in (" Finished ", "+1  Lap", "Power \t Unit", "", "Disqualified")] + [row]}
    (tmp_path / "season=2000").mkdir()
    pages = [[race], [], [None, {**race, "Results": []}, {k: v for k, v in race.items() if k != "Results"}], None]  # those but the first give no rows
    told = [json.dumps({"MRData": {"offset": "0", "total": "6", "RaceTable": {"Races": p}}}) for p in pages]
    (tmp_path / "season=2000" / "p.json").write_text("\n".join(told))
    snap = S.read_strict(spark, str(tmp_path), required=False)
    assert S.page_rows(snap).count() == S.combined_results(snap).count() == 6
    assert not [f for f in S.page_rows(snap).schema["race"].dataType if isinstance(f.dataType, ArrayType)]
    out = C.canon_results(snap)
    assert [(r["status_raw"], r["status_category"], r["finish_position"], r["dnf"]) for r in out.orderBy("res_pos").collect()] == [
        ("Finished", "CLASSIFIED", 1, False), ("+1  Lap", "CLASSIFIED", 1, False), ("Power \t Unit", "MECHANICAL", None, True),
        ("UNKNOWN", "OTHER", None, True), ("Disqualified", "DSQ", None, True), ("UNKNOWN", "OTHER", None, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("VariantExpressionEvalUtils.parseJson") == 1
    plan = S.combined_results(snap)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("VariantExpressionEvalUtils.parseJson") == 1


def _numbers(spark, n: int):
    cols = [F.when(F.col("id") % 7 != 0, F.sin("id")).alias("a"), (F.col("id") % 3).alias("b"), F.lit(None).cast("double").alias("c"),
            F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 3).alias("d"), F.lit(2.5).alias("e"), (F.col("id") * 7).alias("f")]
    return spark.range(n).select(*cols)


def test_medians_are_exact_and_few_values_move(spark, monkeypatch):
    """Medians equal Spark's exact percentile, from a thousandth of the values."""
    from priorwise.operators import train as M

    names = list("abcdef")
    for n in (0, 1, 2, 3, 8, 30_001):
        df = _numbers(spark, n)
        told = df.agg(*[F.percentile(c, 0.5).alias(c) for c in names], *[F.count(c).alias(f"{c}n") for c in names]).first()
        got = M.fit_impute(df, names).first()
        assert [str(got[f"{c}__median"]) for c in names] == [str(told[c]) for c in names], n
        assert [got[f"{c}__nonnull"] for c in names] == [told[f"{c}n"] for c in names] and got["__rows"] == n
    few = _numbers(spark, 1000)  # bounds that miss the middle: all values are taken
    assert M.exact_medians(few, {"f": (1000, 0.0, 1.0), "a": (857, 5.0, 6.0)}) == {
        "f": few.agg(F.percentile("f", 0.5)).first()[0], "a": few.agg(F.percentile("a", 0.5)).first()[0]}
    monkeypatch.setattr(F, "percentile", None)  # no aggregate that holds every value
    M.fit_impute(_numbers(spark, 100), names)


def test_training_features_move_once(spark):
    """The wide frame meets labels and practice in one join."""
    from priorwise.plans.queries_model import m1_frame

    plan = m1_frame(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Project") and plan.splitlines()[1].startswith("+- Join Inner")


def test_rescale_reads_no_stored_features(spark, entry_mod, monkeypatch):
    """The rate and the prior come from the results; the wide feature tables are not built for them."""
    from priorwise.plans import carriers as K

    monkeypatch.setattr(K, "_STORED", {})
    assert entry_mod.queries()["rescale_to_rate"](spark, entry_mod.SF_SMOKE).count() > 0
    assert not {name for *_, name in K._STORED} & {"features_baseline", "features_post_quali"}


def test_scores_of_heats_are_computed_once(spark, entry_mod):
    """Draws, grid and comparisons read the written scores: no prior is computed again in their plans."""
    for name in ("compare_dist_detail", "compare_dist_dnf", "dense_matrix", "eval_dist"):
        plan = entry_mod.queries()[name](spark, entry_mod.SF_SMOKE)._jdf.queryExecution().analyzed().toString()
        assert "driver_q_avg_pos_season_prior" not in plan
