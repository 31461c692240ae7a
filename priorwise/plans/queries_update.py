"""Registered queries of the update cycle: strict scans, page chains, versioned tables, replay, leak audit, evaluation
snapshots and the latest stored round (S1, S2, S8, U1, U3, U4, V8, C8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.operators import canon as C
from priorwise.operators import evaluate as V
from priorwise.operators.audit import metamorphic_audit
from priorwise.operators.dist import rank_by_score
from priorwise.operators.replay import walk_forward
from priorwise.plans import carriers as K
from priorwise.plans import features as FT
from priorwise.plans import queries_model as QM
from priorwise.plans import snapshots as SN
from priorwise.plans.carriers import with_carriers
from priorwise.plans.queries_asof import SQL_SP
from priorwise.plans.queries_score import K8_SQL, V4_CTE, _eval_top, k8_predictions
from priorwise.plans.registry import big, r6, register
from priorwise.session import scratch_path
from priorwise.sources import snapshot as S
from priorwise.sources import store as ST
from priorwise.sources import tables as T
from priorwise.sources.versions import SeasonTables


def _score_sql(ctes: str, select: str, *extra: str) -> str:
    return with_carriers(SQL_SP + K8_SQL + ctes + "\n" + select, "k1", "k2", "k3", *extra)


# ---------------------------------------------------------------------------
# Strict scan of pretty-printed documents, one a file, with documents at fault among them
# ---------------------------------------------------------------------------
#: A document at fault for each reason, beside the calendars of the same season.
FAULTY = {"bad_json": '{"MRData": {', "root_not_object": "[1, 2]", "mrdata_not_object": '{"MRData": "none"}',
          "records_missing": '{"MRData": {"RaceTable": {"season": "%d"}}}',
          "records_not_array": '{"MRData": {"RaceTable": {"Races": {"round": "1"}}}}'}


@register("scan_snapshot_strict", with_carriers("""
SELECT CAST(season AS BIGINT) AS season, 'sound' AS fault, CAST(1 AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS races,
       CAST(sum(round) AS BIGINT) AS rounds_sum, min(race_date) AS first_date FROM k2 GROUP BY 1
UNION ALL SELECT CAST(season AS BIGINT), f.fault, 1, 0, NULL, NULL FROM (SELECT DISTINCT season FROM k2) s
CROSS JOIN (VALUES ('bad_json'), ('root_not_object'), ('mrdata_not_object'), ('records_missing'), ('records_not_array')) f(fault)""", "k2"))
def q_scan_snapshot_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Each season's calendar and its documents at fault: the sound ones are shredded, the others kept with their reason."""
    root = scratch_path(spark, "strict-calendars")
    k2 = K.weekends(spark, sf)
    pretty = SN.calendar_docs(k2).withColumn("value", F.regexp_replace("value", r'([{\[,])"', '$1\n  "'))
    pretty.write.partitionBy("season").option("maxRecordsPerFile", 1).text(root)
    seasons = k2.select("season").distinct()
    for text in FAULTY.values():
        bad = seasons.withColumn("value", F.format_string(text, "season") if "%d" in text else F.lit(text))
        bad.write.mode("append").partitionBy("season").option("maxRecordsPerFile", 1).text(root)
    docs = S.read_strict(spark, root, "races", multiline=True, on_fault="keep")
    races = F.coalesce(F.col("MRData.RaceTable.Races"), F.array())
    per = docs.select("season", F.coalesce("fault", F.lit("sound")).alias("fault"), F.size(races).alias("n"),
                      F.transform(races, lambda r: r["round"].cast("long")).alias("rounds"), F.array_min(races["date"]).alias("first"))
    return per.groupBy(big("season").alias("season"), "fault").agg(
        F.count(F.lit(1)).alias("documents"), big(F.sum("n")).alias("races"),
        F.sum(F.expr("CASE WHEN n > 0 THEN aggregate(rounds, 0L, (a, x) -> a + x) END")).alias("rounds_sum"), F.min("first").alias("first_date"))


# ---------------------------------------------------------------------------
# Chain of pages with planted gaps, repeats, shifted offsets and understated totals
# ---------------------------------------------------------------------------
LOST, REPEATED, SHIFTED, SHORT = (11, 4), (7, 3), (13, 5), 3  # of round + page, modulo; seasons divisible by SHORT announce 5 rows fewer


def faulty_pages(pages: DataFrame) -> DataFrame:
    """Pages lost, repeated, or numbered ten rows too low, and totals that are too small."""
    at = (F.col("round") + F.col("page")).cast("bigint")

    def planted(rule: tuple[int, int]) -> F.Column:
        return at % rule[0] == rule[1]

    kept = pages.where(~planted(LOST)).withColumns({
        "offset": F.when(planted(SHIFTED), F.greatest(F.col("offset") - 10, F.lit(0))).otherwise(F.col("offset")),
        "total": F.when(F.col("season") % SHORT == 0, F.greatest(F.col("total") - 5, F.lit(0))).otherwise(F.col("total"))})
    return kept.unionByName(kept.where(planted(REPEATED)))


def _faulty_results(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "faulty-pages")
    docs = SN.results_pages(K.results(spark, sf), K.weekends(spark, sf), faulty_pages)
    docs.write.partitionBy("season").text(root)
    return S.read_strict(spark, root, "races", required=False)


PAGES_CTE = f""",
pg0 AS (
  SELECT season, round, page, min(before) + page * {SN.PAGE_LIMIT} AS first, count(*) AS n,
         (SELECT count(*) FROM k1 t WHERE t.season = f.season) AS total
  FROM (SELECT k.season, k.round, (k.qualifying_position - 1) // {SN.PAGE_LIMIT} AS page,
               (SELECT count(*) FROM k1 e WHERE e.season = k.season AND e.round < k.round) AS before
        FROM k1 k) f
  GROUP BY season, round, page
),
pg1 AS (
  SELECT season, round, page, n,
         CASE WHEN (round + page) % {SHIFTED[0]} = {SHIFTED[1]} THEN greatest(first - 10, 0) ELSE first END AS first,
         CASE WHEN season % {SHORT} = 0 THEN greatest(total - 5, 0) ELSE total END AS total
  FROM pg0 WHERE (round + page) % {LOST[0]} <> {LOST[1]}
),
pg AS (SELECT * FROM pg1 UNION ALL SELECT * FROM pg1 WHERE (round + page) % {REPEATED[0]} = {REPEATED[1]}),
numbers AS (SELECT season, unnest(range(first, first + n)) AS number, total, first, round FROM pg)"""


@register("page_chain_audit", with_carriers(PAGES_CTE + """
, held AS (SELECT season, number, count(*) AS times FROM numbers GROUP BY 1, 2),
per AS (SELECT season, count(*) AS pages, max(total) AS total, sum(n) AS rows, max(first + n) AS top FROM pg GROUP BY 1),
cut AS (SELECT n.season, count(*) AS past FROM numbers n WHERE n.number >= n.total GROUP BY 1),
-- a gap is counted up to the furthest number that any page reaches, and on to the total
gaps AS (SELECT p.season, greatest(p.top, p.total) - count(h.number) AS gap FROM per p LEFT JOIN held h ON h.season = p.season GROUP BY p.season, p.top, p.total),
over AS (SELECT season, sum(times - 1) AS overlap FROM held GROUP BY 1)
SELECT CAST(p.season AS BIGINT) AS season, CAST(p.pages AS BIGINT) AS pages, CAST(p.total AS BIGINT) AS total, CAST(p.rows AS BIGINT) AS rows,
       CAST(g.gap AS BIGINT) AS gap_rows, CAST(o.overlap AS BIGINT) AS overlap_rows, CAST(coalesce(c.past, 0) AS BIGINT) AS past_total_rows,
       CAST(0 AS BIGINT) AS bad_pages,
       CAST(g.gap = 0 AND o.overlap = 0 AND coalesce(c.past, 0) = 0 AS BIGINT) AS complete
FROM per p JOIN gaps g USING (season) JOIN over o USING (season) LEFT JOIN cut c USING (season)""", "k1"))
def q_page_chain_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = S.chain_audit(S.page_chain(_faulty_results(spark, sf)))
    return out.select(*[big(c).alias(c) for c in out.columns])


@register("page_chain_combine", with_carriers(PAGES_CTE + """
SELECT CAST(n.season AS BIGINT) AS season, CAST(count(DISTINCT n.number) AS BIGINT) AS rows, CAST(min(n.number) AS BIGINT) AS first_number,
       CAST(max(n.number) AS BIGINT) AS last_number
FROM numbers n WHERE n.number < n.total GROUP BY 1""", "k1"))
def q_page_chain_combine(spark: SparkSession, sf: str) -> DataFrame:
    """Each result number once, whatever pages overlap or repeat."""
    rows = S.combined_results(_faulty_results(spark, sf))
    return rows.groupBy(big("season").alias("season")).agg(F.count("res").alias("rows"), big(F.min("number")).alias("first_number"),
                                                           big(F.max("number")).alias("last_number"))


#: What a page's race lacks, by (round + page) modulo RACE_MOD.
RACE_MOD = 7
LACKS = {1: "race_missing_round", 2: "race_missing_name", 3: "race_missing_date", 4: "race_missing_circuit"}


def incomplete_races(pages: DataFrame) -> DataFrame:
    at = (F.col("round") + F.col("page")).cast("bigint") % RACE_MOD
    return pages.withColumns({"round": F.when(at != 1, F.col("round")), "race_name": F.when(at == 2, " ").otherwise(F.col("race_name")),
                              "race_date": F.when(at != 3, F.col("race_date")), "circuit_id": F.when(at != 4, F.col("circuit_id"))})


@register("quarantine_reasons", with_carriers(f"""
SELECT CAST(season AS BIGINT) AS season, reason, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT season, CASE (round + (qualifying_position - 1) // {SN.PAGE_LIMIT}) % {RACE_MOD} {" ".join(f"WHEN {k} THEN '{v}'" for k, v in LACKS.items())}
    ELSE CASE WHEN (driver_id + round) % {SN.EMPTY_DRIVER_MOD} = 0 THEN 'empty_driver_id'
              WHEN (driver_id + round) % {SN.EMPTY_CONSTRUCTOR_MOD} = 0 THEN 'empty_constructor_id' END END AS reason
  FROM k1) t
WHERE reason IS NOT NULL GROUP BY 1, 2""", "k1"))
def q_quarantine_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """All six reasons for which a result row is set aside, counted."""
    root = scratch_path(spark, "incomplete-races")
    SN.results_pages(K.results(spark, sf), K.weekends(spark, sf), incomplete_races).write.partitionBy("season").text(root)
    found = C.quarantine_counts(S.read_strict(spark, root, "races", required=False))
    return found.select(big("season").alias("season"), "reason", "rows")


# ---------------------------------------------------------------------------
# Race, qualifying and sprint tables updated together
# ---------------------------------------------------------------------------
UPDATED, KNOWN_ROUND = 2001, 4  # the season that is updated, and the last round the first version has of it


def canonical_results(spark: SparkSession, root: str, season: int | None = None) -> dict[str, DataFrame]:
    """The three result tables read from their snapshots: all seasons, or one season's folders alone."""
    def snap(kind: str) -> DataFrame:
        docs = S.read_strict(spark, f"{root}/{kind}", "races", required=False)
        return docs if season is None else docs.where(F.col("season") == season)

    out = {"results_race": C.canon_results(snap("results")), "results_qualifying": C.canon_quali(snap("qualifying")),
           "results_sprint": C.canon_results(snap("sprint"), sprint=True)}
    return {n: df.drop("source_path", "offset", "race_pos", "res_pos") for n, df in out.items()}


def update_results(tables: SeasonTables, snapshots: str, season: int) -> int:
    """Read a season's snapshots anew and publish its race, qualifying and sprint rows as one version."""
    return tables.commit(canonical_results(tables.spark, snapshots, season))


_SOUND = f"(f.driver_id + f.round) % {SN.EMPTY_DRIVER_MOD} <> 0 AND (f.driver_id + f.round) % {SN.EMPTY_CONSTRUCTOR_MOD} <> 0"


def _table_sql(name: str, source: str, position: str, where: str = "TRUE") -> str:
    return f"""SELECT v.version, '{name}' AS table_name, CAST(f.season AS BIGINT) AS season, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(DISTINCT f.round) AS BIGINT) AS rounds, CAST(sum({position}) AS BIGINT) AS position_sum
FROM {source} f CROSS JOIN (VALUES ('first'), ('updated')) v(version)
WHERE {_SOUND} AND {where} AND (v.version = 'updated' OR f.season < {UPDATED} OR f.season = {UPDATED} AND f.round <= {KNOWN_ROUND}) GROUP BY 1, 2, 3"""


@register("update_all_tables", with_carriers("\n" + _table_sql("results_race", "k1", "f.finish_position") + "\nUNION ALL "
                                             + _table_sql("results_qualifying", "k1", "f.qualifying_position") + "\nUNION ALL "
                                             + _table_sql("results_sprint", "k9", "f.finish_position"), "k1", "k9"))
def q_update_all_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The three tables as of the first version and after the update, side by side."""
    snapshots = SN.ensure_snapshots(spark, sf)
    tables = SeasonTables(spark, scratch_path(spark, "season-tables"))
    everything = canonical_results(spark, snapshots)
    known = (F.col("season") < UPDATED) | ((F.col("season") == UPDATED) & (F.col("round") <= KNOWN_ROUND))
    first = tables.commit({n: df.where(known) for n, df in everything.items()})
    update_results(tables, snapshots, UPDATED)
    out = None
    for version, label in ((first, "first"), (None, "updated")):
        for name, position in (("results_race", "finish_position"), ("results_qualifying", "qualifying_position"), ("results_sprint", "finish_position")):
            rows = tables.read(name, version)
            part = rows.groupBy(big("season").alias("season")).agg(
                F.count(F.lit(1)).alias("rows"), F.count_distinct("round").alias("rounds"), big(F.sum(position)).alias("position_sum")) \
                .select(F.lit(label).alias("version"), F.lit(name).alias("table_name"), "season", "rows", "rounds", "position_sum")
            out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------------
# Walk-forward replay
# ---------------------------------------------------------------------------
REFITS = [(1997, 1), (1998, 1), (1999, 4), (2000, 7), (2001, 2)]


@register("walk_forward_replay", with_carriers(SQL_SP + f""",
pt AS (SELECT * FROM (VALUES {", ".join(f"({s}, {r}, {s * 100 + r})" for s, r in REFITS)}) p(model_season, model_round, point)),
rd AS (
  SELECT d.season, d.round, max(p.point) AS point FROM (SELECT DISTINCT season, round FROM sp) d JOIN pt p ON p.point <= d.season * 100 + d.round GROUP BY 1, 2
),
fits AS (
  SELECT p.point, k.driver_id, avg(CAST(k.qualifying_position AS DOUBLE)) AS score
  FROM pt p JOIN k1 k ON k.season * 100 + k.round < p.point WHERE k.qualifying_position IS NOT NULL GROUP BY 1, 2
),
sc AS (
  SELECT s.season, s.round, s.driver_id, p.model_season, p.model_round, f.score
  FROM sp s JOIN rd r ON r.season = s.season AND r.round = s.round JOIN pt p ON p.point = r.point
  LEFT JOIN fits f ON f.point = r.point AND f.driver_id = s.driver_id
)
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, driver_id, CAST(model_season AS BIGINT) AS model_season,
       CAST(model_round AS BIGINT) AS model_round, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY season, round ORDER BY score ASC NULLS LAST, driver_id) AS BIGINT) AS predicted_position
FROM sc""", "k1", "k2", "k3"))
def q_walk_forward_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Five versions of a mean-position model, each fitted from tables that hold no round from its as-of point on."""
    tables = SeasonTables(spark, scratch_path(spark, "replay-tables"))
    k1 = K.results(spark, sf).select("season", "round", "driver_id", "qualifying_position")
    spine = FT.baseline_spine(spark, sf).select(big("season").alias("season"), big("round").alias("round"), "driver_id")
    done: list[tuple[int, int]] = []

    def update(point: tuple[int, int]) -> None:
        """Publish the seasons that have rounds between the point before and this one."""
        season, round_ = point
        known = (F.col("season") < season) | ((F.col("season") == season) & (F.col("round") < round_))
        tables.commit({"qualifying": k1.where(known & (F.col("season") >= (done[-1][0] if done else 0)))})
        done.append(point)

    def fit(point: tuple[int, int]) -> DataFrame:
        return T.staged(tables.read("qualifying").groupBy("driver_id").agg(F.avg("qualifying_position").alias("score")), "mean-model")

    def score(model: DataFrame, rounds: DataFrame) -> DataFrame:
        return rank_by_score(spine.join(rounds, ["season", "round"], "left_semi").join(model, "driver_id", "left"))

    back = walk_forward(spine, REFITS, fit, score, scratch_path(spark, "replay"), "post_practice", "quali_top", update)
    return back.select(big("season").alias("season"), big("round").alias("round"), "driver_id", big("model_season").alias("model_season"),
                       big("model_round").alias("model_round"), r6("score").alias("score"), "predicted_position")


# ---------------------------------------------------------------------------
# U4: metamorphic audit of every family
# ---------------------------------------------------------------------------
CUTOFF = (1998, 7)
BASELINE_PRIORS = [n for n, _ in FT.BASELINE_CONTRACT if n.endswith("_prior")]
SPRINT_PRIORS = ["sprint_avg_finish_season_prior", "sprint_dnf_rate_season_prior", "constructor_sprint_avg_finish_season_prior"]
RACE_PRIORS = ["race_avg_finish_season_prior", "race_dnf_rate_season_prior", "constructor_race_avg_finish_season_prior"]
MEASURES = {"race": ["qualifying_position", "grid_position", "finish_position", "dnf"], "sprint": ["finish_position", "dnf"]}


def audit_families(spark: SparkSession, sf: str, cutoff: tuple[int, int] = CUTOFF, spoil=None) -> DataFrame:
    """U4 over F3-F11 (baseline), F16 (sprints) and F18 (races). ``spoil``: a change to the baseline frame, to plant a leak in tests."""
    k1, k2 = K.results(spark, sf), K.weekends(spark, sf)
    mapping = K.weekend_track_types(spark, sf)
    spine = FT.baseline_spine(spark, sf)
    base = QM.post_quali_base(spark, sf).select("season", "round", "driver_id", "constructor_id")
    entries = spine.select("season", "round", "driver_id", "constructor_id")

    def baseline(facts) -> DataFrame:
        race = FT.with_context(facts["race"], k2, mapping).withColumn("fmg", FT.finish_minus_grid_col())
        out = FT.build_baseline(spine, race, facts["entries"])
        return spoil(out, facts) if spoil else out

    def form(facts) -> DataFrame:
        return QM.race_priors(QM.sprint_priors(base, facts["sprint"]), facts["race"], base)

    facts = {"race": k1.drop("rev", "qty"), "entries": entries, "sprint": K.sprint_results(spark, sf, k1)}
    one = metamorphic_audit(baseline, {n: facts[n] for n in ("race", "entries")}, MEASURES, BASELINE_PRIORS, cutoff)
    two = metamorphic_audit(form, {n: facts[n] for n in ("race", "sprint")}, MEASURES, SPRINT_PRIORS + RACE_PRIORS, cutoff)
    return one.unionByName(two)


@register("leak_audit_all", with_carriers(SQL_SP + f"""
SELECT c.column_name, CAST(count(*) AS BIGINT) AS checked_rows, CAST(count(DISTINCT (s.season, s.round)) AS BIGINT) AS checked_periods,
       CAST(0 AS BIGINT) AS mismatched_periods,
       -- teammates are only where a constructor has two drivers in a season
       CAST(c.column_name NOT LIKE '%teammate%' OR EXISTS (SELECT 1 FROM k1 WHERE season >= {CUTOFF[0]} GROUP BY season, constructor_id
                                                           HAVING count(DISTINCT driver_id) > 1) AS BIGINT) AS seen_later
FROM sp s CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in BASELINE_PRIORS + SPRINT_PRIORS + RACE_PRIORS)}) c(column_name)
WHERE s.season < {CUTOFF[0]} OR s.season = {CUTOFF[0]} AND s.round <= {CUTOFF[1]} GROUP BY 1""", "k1", "k2", "k3"))
def q_leak_audit_all(spark: SparkSession, sf: str) -> DataFrame:
    out = audit_families(spark, sf)
    return out.select("column_name", big("checked_rows").alias("checked_rows"), big("checked_periods").alias("checked_periods"),
                      big("mismatched_periods").alias("mismatched_periods"), (F.col("changed_later") > 0).cast("bigint").alias("seen_later"))


# ---------------------------------------------------------------------------
# Evaluation snapshots; V8 + X10: the latest round from partition names
# ---------------------------------------------------------------------------
@register("evaluation_snapshots", _score_sql(V4_CTE, """
SELECT 'before' AS as_of, CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, round(mae, 6) AS mae, exact, n FROM v4 WHERE season <= 1999
UNION ALL SELECT 'now', CAST(season AS BIGINT), CAST(round AS BIGINT), round(mae, 6), exact, n FROM v4"""))
def q_evaluation_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """An evaluation taken when seasons up to 1999 were known, and a later one of all: each is read as of its time."""
    found = T.staged(_eval_top(spark, sf).select(big("season").alias("season"), big("round").alias("round"), r6("mae").alias("mae"), "exact", "n"), "eval")
    root = scratch_path(spark, "evaluation-snapshots")
    ST.snapshot_evaluation(found.where("season <= 1999"), root, "quali_top", "baseline", "2000-01-01T00:00:00")
    ST.snapshot_evaluation(found, root, "quali_top", "baseline", "2001-06-01T12:00:00")
    both = [ST.read_evaluation(spark, root, "quali_top", "baseline", at).select(F.lit(name).alias("as_of"), "season", "round", "mae", "exact", "n")
            for name, at in (("before", "2001-06-01T11:59:59"), ("now", None))]
    return both[0].unionByName(both[1])


@register("latest_stored_round", _score_sql("", """
, u AS (SELECT season, round FROM k8r UNION ALL SELECT season, round FROM k1 UNION ALL SELECT season, round FROM k9 UNION ALL SELECT season, round FROM k4)
SELECT CAST(season AS BIGINT) AS season, CAST(max(round) AS BIGINT) AS round FROM u
WHERE season = (SELECT max(season) FROM u) GROUP BY 1""", "k4", "k9"))
def q_latest_stored_round(spark: SparkSession, sf: str) -> DataFrame:
    """V8 over predictions, race, qualifying, sprint and practice tables: from their folders' names, without a look at any row."""
    root = scratch_path(spark, "by-round")
    k1 = K.results(spark, sf)
    stored = {"race": k1.where("finish_position IS NOT NULL"), "qualifying": k1.where("qualifying_position IS NOT NULL"),
              "sprint": K.sprint_results(spark, sf, k1), "practice": K.session_results(spark, sf)}
    for name, df in stored.items():
        T.write_partitioned(df.hint("rebalance", "season", "round"), f"{root}/{name}", ["season", "round"])
    predictions = k8_predictions(spark, sf).select("season", "round", "driver_id", "predicted_position")
    ST.store_predictions(predictions, f"{root}/predictions", "post_practice", "quali_top")
    found = V.latest_stored_round([T.partition_paths(spark, f"{root}/{name}") for name in (*stored, "predictions")])
    return found.select(big("season").alias("season"), big("round").alias("round"))
