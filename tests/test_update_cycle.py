"""Two-pass ranks, exact medians, strict scans, page chains, versioned tables, replay, leak audit, snapshots and listings."""

from __future__ import annotations

import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
ORACLE_SET = ["scan_snapshot_strict", "page_chain_audit", "page_chain_combine", "update_all_tables", "walk_forward_replay", "leak_audit_all",
              "evaluation_snapshots", "latest_stored_round", "rank_fallback", "train_frame_race", "canon_weekends", "quarantine_reasons"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ORACLE_SET)
def test_oracle(spark, con, entry_mod, name):
    r = compare(spark, con, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name], SF)
    assert r["status"] == "match", r


# -- ranks in two passes


def rows_with_ties(seed=1):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, 0.5, 1.0, 1.0, 1.0, 2.5, float(rng.randrange(50))])) for i in range(400)]


@pytest.mark.parametrize("parts", [None, 1, 7, 60])
def test_numbers_and_ranks_of_groups_over_many_ranges(spark, parts):
    from priorwise.operators.ranking import numbered, ranked, running

    rows = rows_with_ties()
    df = spark.createDataFrame(rows, "g long, id long, v double")
    key = lambda r: (r[2] is None, r[2] or 0, r[1])
    groups = {g: sorted((r for r in rows if r[0] == g), key=key) for g in {r[0] for r in rows}}
    got = {r["id"]: r["n"] for r in numbered(df, ["g"], [F.col("v").asc_nulls_last(), F.col("id")], "n", parts).collect()}
    assert got == {r[1]: i + 1 for g in groups.values() for i, r in enumerate(g)}
    low = {r["id"]: r["n"] for r in ranked(df, ["g"], "v", "n", parts=parts).collect()}
    mean = {r["id"]: r["n"] for r in ranked(df, ["g"], "v", "n", "average", parts=parts).collect()}
    down = {r["id"]: r["n"] for r in ranked(df, ["g"], "v", "n", descending=True, parts=parts).collect()}
    for g in groups.values():
        values = [r[2] for r in g if r[2] is not None]
        for _, i, v in g:
            if v is None:
                assert low[i] is None and mean[i] is None
            else:
                less, same = sum(x < v for x in values), values.count(v)
                assert low[i] == less + 1 and mean[i] == less + 1 + (same - 1) / 2
                assert down[i] == sum(x > v for x in values) + 1
    for fold, plain in (("sum", sum), ("max", max)):
        got = {r["id"]: r["n"] for r in running(df, ["g"], [F.col("v").asc_nulls_last(), F.col("id")], "id", "n", fold, parts).collect()}
        assert got == {r[1]: plain([x[1] for x in g[:i]]) if i else None for g in groups.values() for i, r in enumerate(g)}
    none = df.where("id < 0")
    assert numbered(none, ["g"], [F.col("id")]).count() == 0 and ranked(none, ["g"], "v").count() == 0


def test_no_window_holds_a_whole_round(spark, entry_mod):
    """Windows keyed by a group alone run over one row a range (an aggregate), never over the group's rows."""
    from priorwise.operators import dist, evaluate, sessions

    scores = spark.createDataFrame([(1, 1, 1, 0.5)], "season int, round int, driver_id long, score double")
    actual = scores.withColumn("finish_position", F.col("driver_id"))
    laps = spark.createDataFrame([(1, 1, "FP1", 1, 5.0, 1)], "season int, round int, session_type string, driver_id long, best_lap_time_ms double, position long")
    agg = scores.withColumn("practice_best_ms", F.col("score"))
    for df in (dist.rank_by_score(scores), sessions.rank_fallback(laps), sessions.practice_rank_gap_z(agg), evaluate.rank_corr(scores, actual)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        for i, line in enumerate(plan):
            keys = re.split(" ASC| DESC", line.partition("windowspecdefinition(")[2])[0].split(",")[:-1]  # the last one orders
            if "Window" in line and not any(k.strip().startswith("__part") for k in keys):
                below = " ".join(plan[i + 1:i + 4])
                assert "Aggregate" in below, plan[i:i + 4]


def test_median_is_exact_over_merged_counts(spark):
    from priorwise.operators.asof import Agg, prior_stats

    rng = random.Random(5)
    facts = [(k, 2000 + s, r, rng.choice([None, float(rng.randrange(6)), rng.random()])) for k in (1, 2) for s in range(2) for r in range(1, 9)
             for _ in range(rng.randrange(4))]
    spine = [(k, 2000 + s, r) for k in (1, 2, 3) for s in range(2) for r in range(1, 10)]
    for scope in ("season", "track", "career"):
        out = prior_stats(spark.createDataFrame(spine, "k long, season int, round int"), spark.createDataFrame(facts, "k long, season int, round int, v double"),
                          ["k"], [Agg("med", "median", "v"), Agg("n", "count", "v"), Agg("rows", "rows"), Agg("low", "min", "v"), Agg("mean", "avg", "v")], scope)
        for r in out.collect():
            earlier = {"season": lambda f: f[1] == r["season"] and f[2] < r["round"], "career": lambda f: f[1] < r["season"],
                       "track": lambda f: (f[1], f[2]) < (r["season"], r["round"])}[scope]
            mine = [f for f in facts if f[0] == r["k"] and earlier(f)]
            values = [f[3] for f in mine if f[3] is not None]
            assert (r["rows"], r["n"]) == (len(mine), len(values))
            assert r["med"] == (pytest.approx(statistics.median(values)) if values else None)
            assert r["low"] == (min(values) if values else None)
            assert r["mean"] == (pytest.approx(sum(values) / len(values)) if values else None)


# -- strict scan and page chain


def document(races, **mrdata):
    return json.dumps({"MRData": {**mrdata, "RaceTable": {"Races": races}}})


FAULTS = {"bad_json": '{"MRData": ', "root_not_object": "3", "mrdata_not_object": '{"MRData": []}', "records_missing": '{"MRData": {}}',
          "records_not_array": document({"round": "1"})}


@pytest.mark.parametrize("fault", FAULTS)
def test_strict_scan_names_the_fault(spark, tmp_path, fault):
    from priorwise.sources.snapshot import read_strict

    folder = tmp_path / "season=2000"
    folder.mkdir()
    (folder / "a.json").write_text(document([{"round": "1", "raceName": "One"}]) + "\n\n" + FAULTS[fault] + "\n")
    kept = {r["fault"]: r for r in read_strict(spark, str(tmp_path), on_fault="keep").collect()}
    assert set(kept) == {None, fault} and kept[fault]["MRData"] is None and kept[fault]["document"] == FAULTS[fault]
    assert kept[None]["MRData"]["RaceTable"]["Races"][0]["raceName"] == "One" and kept[None]["season"] == 2000 and kept[None]["document"] is None
    with pytest.raises(Exception, match=f"{fault}.*a.json"):
        read_strict(spark, str(tmp_path)).select("MRData").collect()


def test_strict_scan_of_whole_files(spark, tmp_path):
    from priorwise.sources.snapshot import read_strict

    folder = tmp_path / "season=1999"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(json.loads(document([{"round": 2, "date": "d", "Circuit": "no object"}, "no object", None], total="3")), indent=2))
    (folder / "b.json").write_text('{"MRData": {"RaceTable": {"Races": null}}}')
    with pytest.raises(Exception, match="records_missing"):
        read_strict(spark, str(tmp_path), multiline=True).select("MRData").collect()
    both = read_strict(spark, str(tmp_path), multiline=True, required=False).orderBy("source_path").collect()
    races = both[0]["MRData"]["RaceTable"]["Races"]
    assert [r and r["round"] for r in races] == ["2", None, None] and races[0]["Circuit"] is None and both[0]["MRData"]["total"] == "3"
    assert both[1]["MRData"]["RaceTable"]["Races"] is None


def pages_of(spark, tmp_path, pages):
    """pages: (offset, total, [(round, position)]) of season 2000."""
    from priorwise.sources.snapshot import read_strict

    folder = tmp_path / "season=2000"
    folder.mkdir(parents=True)
    lines = []
    for offset, total, rows in pages:
        races = {}
        for round_, position in rows:
            races.setdefault(round_, []).append({"position": str(position)})
        lines.append(document([{"round": str(r), "raceName": f"R{r}", "Results": res} for r, res in races.items()], offset=offset, total=total))
    (folder / "p.json").write_text("\n".join(lines))
    return read_strict(spark, str(tmp_path), required=False)


def test_page_chain_on_random_intervals(spark, tmp_path):
    from priorwise.sources.snapshot import chain_audit, combined_results, page_chain

    rng = random.Random(3)
    for trial in range(4):
        total = 60
        numbers = [(1 + i // 20, i % 20) for i in range(total + 10)]
        pages = []
        at = 0
        while at < total:
            n = rng.randint(1, 15)
            start = max(0, at + rng.choice([0, 0, 0, 3, -4]))
            pages.append((str(start), str(total), numbers[start:start + n]))
            if rng.random() < 0.2:
                pages.append(pages[-1])
            at = start + n
        snap = pages_of(spark, tmp_path / str(trial), pages)
        audit = chain_audit(page_chain(snap)).first()
        held = [n for o, _, rows in pages for n in range(int(o), int(o) + len(rows))]
        assert audit["rows"] == len(held) and audit["overlap_rows"] == len(held) - len(set(held))
        assert audit["gap_rows"] == max(total, max(held) + 1) - len(set(held))
        assert audit["past_total_rows"] == sum(n >= total for n in held)
        whole = sorted(held) == list(range(total))
        assert audit["complete"] == int(whole)
        rows = combined_results(snap).orderBy("number").collect()
        assert [(r["number"], int(r["race"]["round"]), int(r["res"]["position"])) for r in rows] == [(n, *numbers[n]) for n in sorted(set(held)) if n < total]


def test_page_chain_faults_of_numbers(spark, tmp_path):
    from priorwise.sources.snapshot import chain_audit, combined_results, page_chain

    rows = [(1, 1), (1, 2)]
    snap = pages_of(spark, tmp_path / "a", [("0", "4", rows), ("x", "4", rows), ("2", None, rows)])
    audit = chain_audit(page_chain(snap)).first()
    assert audit["bad_pages"] == 2 and audit["complete"] == 0
    assert combined_results(snap).count() == 2
    differ = chain_audit(page_chain(pages_of(spark, tmp_path / "b", [("0", "4", rows), ("2", "5", rows)]))).first()
    assert differ["complete"] == 0 and differ["total"] == 5 and differ["gap_rows"] == 1
    empty = chain_audit(page_chain(pages_of(spark, tmp_path / "c", [("0", "0", [])]))).first()
    assert (empty["complete"], empty["rows"], empty["gap_rows"]) == (1, 0, 0)


# -- versioned season tables


def season_rows(spark, rows):
    return spark.createDataFrame(rows, "season int, round int, x string")


def read(tables, name, version=None):
    return sorted((r["season"], r["round"], r["x"]) for r in tables.read(name, version).collect())


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    from priorwise.sources.versions import SeasonTables, VersionConflict

    tables = SeasonTables(spark, str(tmp_path / "t"))
    assert tables.read("race") is None and tables.manifest() == {}
    one = tables.commit({"race": season_rows(spark, [(1, 1, "a"), (2, 1, "a")]), "quali": season_rows(spark, [(1, 1, "q")])})
    broken = season_rows(spark, [(2, 1, "b")]).withColumn("x", F.raise_error(F.lit("lost source")).cast("string"))
    with pytest.raises(Exception, match="lost source"):
        tables.commit({"race": season_rows(spark, [(2, 1, "b"), (3, 1, "b")]), "quali": broken})
    assert tables.versions() == [one] and read(tables, "race") == [(1, 1, "a"), (2, 1, "a")] and read(tables, "quali") == [(1, 1, "q")]
    # the next attempt takes the same number; rows that the failed one left are not seen
    two = tables.commit({"race": season_rows(spark, [(2, 1, "c"), (2, 2, "c")]), "sprint": season_rows(spark, [(2, 1, "s")])})
    assert read(tables, "race") == [(1, 1, "a"), (2, 1, "c"), (2, 2, "c")] and read(tables, "quali") == [(1, 1, "q")] and read(tables, "sprint") == [(2, 1, "s")]
    assert read(tables, "race", one) == [(1, 1, "a"), (2, 1, "a")] and tables.read("sprint", one) is None
    with pytest.raises(VersionConflict):
        tables.publish(two, {})
    with pytest.raises(ValueError):
        tables.read("race", 99)
    plan = tables.read("race").where("season = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    three = tables.commit({"race": season_rows(spark, [(1, 1, "d"), (2, 1, "d")])})
    gone = tables.drop_unnamed(keep=1)
    assert {g.rsplit("/", 2)[-2] + "/" + g.rsplit("/", 1)[-1] for g in gone} == {f"race/version={one}", f"race/version={two}"}
    assert tables.versions() == [three] and read(tables, "race") == [(1, 1, "d"), (2, 1, "d")] and read(tables, "quali") == [(1, 1, "q")]


# -- replay


def test_no_round_is_scored_by_a_later_model(spark):
    from priorwise.operators.replay import assign_versions

    rounds = [(s, r) for s in range(2000, 2004) for r in range(1, 6)]
    points = [(2001, 3), (2000, 4), (2002, 1), (2002, 1), (2003, 9)]
    got = {(r["season"], r["round"]): (r["model_season"], r["model_round"]) for r in
           assign_versions(spark.createDataFrame(rounds + rounds, "season int, round int"), points).collect()}
    assert got == {x: max(p for p in points if p <= x) for x in rounds if x >= (2000, 4)}
    assert all(p <= x for x, p in got.items())


def test_replay_goes_on_where_it_stopped(spark, tmp_path):
    from priorwise.operators.replay import walk_forward

    rounds = spark.createDataFrame([(2000, r) for r in range(1, 7)], "season long, round long")
    fitted, known = [], []

    def score(model, due):
        seen = sorted(r["round"] for r in due.collect())
        assert all(r >= model[1] for r in seen)
        return due.select("season", "round", F.lit(float(model[1])).alias("score")).unionByName(
            spark.createDataFrame([(2000, 1, -1.0)], "season long, round long, score double"))  # a row of another round

    def fit(point):
        assert known[-1] == point  # the tables are up to date first
        fitted.append(point)
        if len(fitted) == 2:
            raise RuntimeError("lost")
        return point

    args = (rounds, [(2000, 2), (2000, 4)], fit, score, str(tmp_path / "p"), "st", "k")
    with pytest.raises(RuntimeError):
        walk_forward(*args, update=known.append)
    out = walk_forward(*args, update=known.append)
    assert sorted((r["round"], r["score"], r["model_round"]) for r in out.collect()) == [(2, 2.0, 2), (3, 2.0, 2), (4, 4.0, 4), (5, 4.0, 4), (6, 4.0, 4)]
    assert fitted == [(2000, 2), (2000, 4), (2000, 4)]


# -- leak audit


def test_a_planted_leak_is_found(spark):
    """A prior that sees its own round: only this column is at fault, and only at the cutoff's round."""
    from priorwise.plans.queries_update import audit_families

    def spoil(frame, facts):
        own = facts["race"].groupBy("season", "round", "driver_id").agg(F.max("qualifying_position").alias("__own"))
        return frame.join(own, ["season", "round", "driver_id"], "left") \
            .withColumn("driver_q_best_pos_season_prior", F.coalesce("__own", "driver_q_best_pos_season_prior"))

    rows = {r["column_name"]: r for r in audit_families(spark, SF, (1998, 7), spoil).collect()}
    assert {c for c, r in rows.items() if r["mismatched_periods"]} == {"driver_q_best_pos_season_prior"}
    assert len(rows) > 30 and all(r["changed_later"] for c, r in rows.items() if "teammate" not in c)


def test_fingerprints_see_every_change(spark):
    from priorwise.sources.models import fingerprint

    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (2, None, 1.5)], "k long, s string, v double")
    one = fingerprint(df, {"trees": 3})
    assert one == fingerprint(df.repartition(3).select("v", "s", "k"), {"trees": 3}) and len(one) == 32
    changed = [df.distinct(), df.where("k = 1"), df.withColumn("v", F.coalesce("v", F.lit(0.0))), df.withColumn("k", F.col("k").cast("int")),
               df.withColumnRenamed("v", "w"), df.where("k < 0")]
    assert len({one, fingerprint(df, {"trees": 4}), *[fingerprint(c, {"trees": 3}) for c in changed]}) == 8
    # a value that moves from one column to another is no permutation of rows
    swap = [spark.createDataFrame([(a, b)], "x string, y string") for a, b in (("p", None), (None, "p"))]
    assert fingerprint(swap[0], {}) != fingerprint(swap[1], {})


def test_changed_rows_and_settings_train_anew(spark, tmp_path):
    from priorwise.sources.models import Artifact, ModelRegistry, fingerprint

    registry, trained = ModelRegistry(spark, str(tmp_path)), []

    def get(df, trees):
        def train():
            trained.append(trees)
            return Artifact(None, {"trees": trees})

        return registry.load_or_train("m", 2000, 1, train, fingerprint(df, {"trees": trees})).meta["trees"]

    df = spark.range(5)
    assert [get(df, 3), get(df.repartition(2), 3), get(df, 4), get(df.where("id > 0"), 3), get(df, 3)] == [3, 3, 4, 3, 3]
    assert trained == [3, 4, 3]


# -- stores


def test_metadata_of_a_store_is_that_of_its_call(spark, tmp_path):
    from priorwise.sources.store import AlreadyStored, store_predictions

    root = str(tmp_path / "p")
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "season int, round int, driver_id long")
    store_predictions(rows.where("round = 1"), root, "st", "k", {"run": "a"})
    store_predictions(rows.where("round = 2"), root, "st", "k", {"run": "b"})
    assert sorted((r["round"], r["meta_run"]) for r in spark.read.parquet(f"{root}_meta").collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(AlreadyStored):
        store_predictions(rows, root, "st", "k")


def test_older_evaluations_stay_readable(spark, tmp_path):
    from priorwise.sources.store import AlreadyStored, read_evaluation, snapshot_evaluation

    root = str(tmp_path / "e")

    def rows(v):
        return spark.createDataFrame([(2000, v)], "season int, mae double")

    snapshot_evaluation(rows(1.0), root, "top", "base", "2024-01-01T00:00:00")
    snapshot_evaluation(rows(2.0), root, "top", "base", "2024-01-02T00:00:00+00:00")
    snapshot_evaluation(rows(9.0), root, "top", "", "2024-01-03T00:00:00")
    now = snapshot_evaluation(rows(3.0), root, "top", "base")

    def mae(**kw):
        return [r["mae"] for r in read_evaluation(spark, root, "top", **{"label": "base", **kw}).collect()]

    assert mae() == [3.0] and now > "2025"
    assert mae(as_of="2024-01-01T12:00:00") == [1.0] and mae(as_of="2024-01-02T01:00:00+01:00") == [2.0]
    assert mae(as_of="2023-01-01T00:00:00") == [] and mae(label="") == [9.0] and mae(label="other") == []
    with pytest.raises(AlreadyStored):
        snapshot_evaluation(rows(4.0), root, "top", "base", "2024-01-01T00:00:00")


def test_latest_round_opens_no_file(spark, entry_mod, tmp_path):
    from priorwise.operators.evaluate import latest_stored_round
    from priorwise.sources.tables import partition_paths

    df = entry_mod.queries()["latest_stored_round"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Scan parquet" not in plan
    for part in ("a/season=2000/round=3", "b/season=2001/round=2", "b/season=1999/round=9", "c/season=x/round=1"):
        (tmp_path / part).mkdir(parents=True)
    found = latest_stored_round([partition_paths(spark, str(tmp_path / n)) for n in ("a", "b", "c", "none")]).first()
    assert (found["season"], found["round"]) == (2001, 2)
    assert tuple(latest_stored_round([partition_paths(spark, str(tmp_path / "none"))]).first()) == (None, 1)


def test_upsert_reads_touched_partitions_only(spark, tmp_path):
    from priorwise.streaming.update import upsert_partitions

    root, staging = str(tmp_path / "t"), str(tmp_path / "s")
    rows = spark.createDataFrame([(s, r, 1, 0, "old") for s in (1, 2, 3) for r in (1, 2)], "season int, round int, id int, version int, x string")
    upsert_partitions(rows, root, ["season", "round", "id"], ["season", "round"], "version", staging)
    spark.read.parquet(root).count()
    (tmp_path / "t" / "season=3" / "round=1" / "part-broken.parquet").write_bytes(b"not parquet")  # read only if its partition is
    batch = spark.createDataFrame([(2, 1, 1, 1, "new"), (1, 2, 2, 0, "more")], rows.schema)
    upsert_partitions(batch, root, ["season", "round", "id"], ["season", "round"], "version", staging)
    got = sorted((r["season"], r["round"], r["id"], r["x"]) for r in spark.read.parquet(f"{root}").where("season < 3").collect())
    assert got == [(1, 1, 1, "old"), (1, 2, 1, "old"), (1, 2, 2, "more"), (2, 1, 1, "new"), (2, 2, 1, "old")]
    assert not (tmp_path / "s").exists()
