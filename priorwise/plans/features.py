"""Assembled feature frames (F1-F19) over canonical-shaped inputs.

Inputs are canonical-shaped DataFrames: a spine of entries
(season, round, driver_id, constructor_id, circuit_id, race_date), weekends,
qualifying and race results. Here they are built from the carriers; the
functions below only rely on those column names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions.schema import enforce
from priorwise.operators.asof import Agg, group_prior_stats, leave_one_out_delta, prior_stats
from priorwise.plans import carriers as K
from priorwise.sources.tables import staged

F3_COLS = ["driver_season_quali_count_prior", "driver_q_avg_pos_season_prior",
           "driver_q_med_pos_season_prior", "driver_q_best_pos_season_prior",
           "driver_q_worst_pos_season_prior"]
F4_COLS = ["constructor_season_quali_count_prior", "constructor_q_avg_pos_season_prior",
           "constructor_q_best_pos_season_prior"]
F6_COLS = ["driver_season_race_starts_prior", "driver_season_dnfs_prior", "driver_season_dnf_rate_prior"]
F7_COLS = ["driver_career_quali_count_prior", "driver_q_avg_pos_career_prior",
           "constructor_career_quali_count_prior", "constructor_q_avg_pos_career_prior"]
F8D_COLS = ["driver_q_count_at_circuit_prior", "driver_q_avg_pos_at_circuit_prior"]
F8C_COLS = ["constructor_q_count_at_circuit_prior", "constructor_q_avg_pos_at_circuit_prior"]
F9_COLS = ["driver_q_count_at_track_type_prior", "driver_q_avg_pos_at_track_type_prior",
           "constructor_q_count_at_track_type_prior", "constructor_q_avg_pos_at_track_type_prior"]
F11_COLS = ["driver_finish_minus_grid_avg_season_prior", "driver_finish_minus_grid_count_season_prior",
            "driver_finish_minus_grid_avg_career_prior", "driver_finish_minus_grid_count_career_prior"]

Q = "qualifying_position"

GROUP_SEASON = [Agg("constructor_season_quali_count_prior", "count", Q), Agg("constructor_q_avg_pos_season_prior", "avg", Q),
                Agg("constructor_q_best_pos_season_prior", "min", Q, "bigint")]
GROUP_CAREER = [Agg("constructor_career_quali_count_prior", "count", Q), Agg("constructor_q_avg_pos_career_prior", "avg", Q)]
GROUP_CIRCUIT = [Agg("constructor_q_count_at_circuit_prior", "count", Q), Agg("constructor_q_avg_pos_at_circuit_prior", "avg", Q)]
DRIVER_TRACK_TYPE = [Agg("driver_q_count_at_track_type_prior", "count", Q), Agg("driver_q_avg_pos_at_track_type_prior", "avg", Q)]
GROUP_TRACK_TYPE = [Agg("constructor_q_count_at_track_type_prior", "count", Q),
                    Agg("constructor_q_avg_pos_at_track_type_prior", "avg", Q)]

# The 40-column baseline contract, in order (name, Spark type).
BASELINE_CONTRACT = [
    ("season", "bigint"), ("round", "bigint"), ("weekend_id", "string"), ("race_name", "string"),
    ("circuit_id", "bigint"), ("race_date", "string"), ("driver_id", "bigint"),
    ("constructor_id", "bigint"), ("checkpoint", "string"), ("session_type", "string"),
    ("driver_season_quali_count_prior", "bigint"), ("constructor_season_quali_count_prior", "bigint"),
    ("driver_career_quali_count_prior", "bigint"), ("constructor_career_quali_count_prior", "bigint"),
    ("driver_q_avg_pos_season_prior", "double"), ("driver_q_med_pos_season_prior", "double"),
    ("driver_q_best_pos_season_prior", "bigint"), ("driver_q_worst_pos_season_prior", "bigint"),
    ("constructor_q_avg_pos_season_prior", "double"), ("constructor_q_best_pos_season_prior", "bigint"),
    ("driver_vs_teammate_q_avg_delta_season_prior", "double"),
    ("driver_season_race_starts_prior", "bigint"), ("driver_season_dnfs_prior", "bigint"),
    ("driver_season_dnf_rate_prior", "double"),
    ("driver_q_avg_pos_career_prior", "double"), ("constructor_q_avg_pos_career_prior", "double"),
    ("driver_q_count_at_circuit_prior", "bigint"), ("driver_q_avg_pos_at_circuit_prior", "double"),
    ("constructor_q_count_at_circuit_prior", "bigint"), ("constructor_q_avg_pos_at_circuit_prior", "double"),
    ("track_type", "string"),
    ("driver_q_count_at_track_type_prior", "bigint"), ("driver_q_avg_pos_at_track_type_prior", "double"),
    ("constructor_q_count_at_track_type_prior", "bigint"),
    ("constructor_q_avg_pos_at_track_type_prior", "double"),
    ("driver_constructor_tenure_rounds_prior", "bigint"),
    ("driver_finish_minus_grid_avg_season_prior", "double"),
    ("driver_finish_minus_grid_avg_career_prior", "double"),
    ("driver_finish_minus_grid_count_season_prior", "bigint"),
    ("driver_finish_minus_grid_count_career_prior", "bigint"),
]


# ---------------------------------------------------------------------------
# F1 / F2: spine joins
# ---------------------------------------------------------------------------
def attach_weekend(spine: DataFrame, weekends: DataFrame) -> DataFrame:
    """spine left-joined to weekends on (season, round, circuit, race_date) -> weekend_id."""
    wk = weekends.select("season", "round", "circuit_id", "race_date", "weekend_id", "race_name")
    return spine.join(wk, ["season", "round", "circuit_id", "race_date"], "left")


def attach_track_type(spine: DataFrame, mapping: DataFrame) -> DataFrame:
    """track type by weekend id, or by (season, round) when the mapping has those keys."""
    if "weekend_id" in mapping.columns:
        m = mapping.select("weekend_id", "track_type").dropDuplicates(["weekend_id"])
        return spine.join(m, "weekend_id", "left")
    m = mapping.select("season", "round", "track_type").dropDuplicates(["season", "round"])
    return spine.join(m, ["season", "round"], "left")


def with_context(facts: DataFrame, weekends: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts with circuit, weekend id and track type (for the track-scope priors)."""
    wk = weekends.select("season", "round", "circuit_id", "weekend_id")
    cols = [c for c in facts.columns if c not in ("circuit_id", "weekend_id")]
    out = facts.select(*cols).join(wk, ["season", "round"])
    return attach_track_type(out, mapping)


def finish_minus_grid_col() -> F.Column:
    ok = (F.col("dnf") == 0) & F.col("finish_position").isNotNull() & F.col("grid_position").isNotNull()
    return F.when(ok, F.col("finish_position") - F.col("grid_position"))


def baseline_spine(spark: SparkSession, sf: str) -> DataFrame:
    k2 = K.weekends(spark, sf)
    k3 = K.entries(spark, sf, k2=k2)
    sp = attach_weekend(k3, k2)
    return attach_track_type(sp, K.weekend_track_types(spark, sf))


def baseline_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(spine, facts) for the baseline features from the carriers."""
    k1 = K.results(spark, sf)
    k2 = K.weekends(spark, sf)
    mapping = K.weekend_track_types(spark, sf)
    sp = attach_track_type(attach_weekend(K.entries(spark, sf, k1, k2), k2), mapping)
    facts = with_context(k1, k2, mapping).withColumn("fmg", finish_minus_grid_col())
    return sp, facts


# ---------------------------------------------------------------------------
# F3 - F11 on (spine, facts)
# ---------------------------------------------------------------------------
def entity_season_form(sp: DataFrame, facts: DataFrame) -> DataFrame:
    """F3 (+ F6, F11 season when asked): one window keyed by (driver, season)."""
    out = prior_stats(sp, facts, ["driver_id"], [
        Agg("driver_season_quali_count_prior", "count", Q),
        Agg("driver_q_avg_pos_season_prior", "avg", Q),
        Agg("driver_q_med_pos_season_prior", "median", Q),
        Agg("driver_q_best_pos_season_prior", "min", Q, "bigint"),
        Agg("driver_q_worst_pos_season_prior", "max", Q, "bigint"),
    ], scope="season")
    return out


def group_season_form(sp: DataFrame, facts: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """constructor season form over all its cars (pre-aggregated per period)."""
    out = group_prior_stats(sp, facts, ["constructor_id"], GROUP_SEASON, scope="season", base=base if base is not None else sp)
    return out


def teammate_delta(sp: DataFrame, facts: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """leave-one-out teammate delta of season-prior qualifying means."""
    out = leave_one_out_delta(sp, facts, "constructor_id", "driver_id", Q,
                              "driver_vs_teammate_q_avg_delta_season_prior", base)
    return out


def reliability(sp: DataFrame, race_facts: DataFrame) -> DataFrame:
    """prior starts (all rows), dnfs and rate (null when no starts)."""
    out = prior_stats(sp, race_facts, ["driver_id"], [
        Agg("driver_season_race_starts_prior", "rows"),
        Agg("__dnfs", "sum", "dnf"),
    ], scope="season")
    dnfs = F.coalesce(F.col("__dnfs"), F.lit(0)).cast("bigint")
    return out.withColumns({
        "driver_season_dnfs_prior": dnfs,
        "driver_season_dnf_rate_prior": F.col("__dnfs") / F.when(
            F.col("driver_season_race_starts_prior") > 0, F.col("driver_season_race_starts_prior")),
    }).drop("__dnfs")


def career_form(sp: DataFrame, facts: DataFrame) -> DataFrame:
    """driver and constructor career count + mean (seasons < S)."""
    out = prior_stats(sp, facts, ["driver_id"], [
        Agg("driver_career_quali_count_prior", "count", Q),
        Agg("driver_q_avg_pos_career_prior", "avg", Q)], scope="career")
    out = group_prior_stats(out, facts, ["constructor_id"], GROUP_CAREER, scope="career", base=sp)
    return out


def circuit_form(sp: DataFrame, facts: DataFrame, who: str = "both", base: DataFrame | None = None) -> DataFrame:
    """F8: (entity, circuit) and (group, circuit) priors over earlier periods."""
    out = sp
    if who in ("driver", "both"):
        out = prior_stats(out, facts, ["driver_id", "circuit_id"], [
            Agg("driver_q_count_at_circuit_prior", "count", Q),
            Agg("driver_q_avg_pos_at_circuit_prior", "avg", Q)], scope="track")
    if who in ("constructor", "both"):
        out = group_prior_stats(out, facts, ["constructor_id", "circuit_id"], GROUP_CIRCUIT, scope="track",
                                base=base if base is not None else sp)
    return out


def track_type_form(sp: DataFrame, facts: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(entity, type) and (group, type) priors; 0 / null when the type is unknown."""
    out = prior_stats(sp, facts, ["driver_id", "track_type"], DRIVER_TRACK_TYPE, scope="track")
    out = group_prior_stats(out, facts, ["constructor_id", "track_type"], GROUP_TRACK_TYPE, scope="track",
                            base=base if base is not None else sp)
    return out


def tenure(sp: DataFrame, entries: DataFrame) -> DataFrame:
    """prior entries rows of the (entity, group) pair."""
    return prior_stats(sp, entries, ["driver_id", "constructor_id"], [
        Agg("driver_constructor_tenure_rounds_prior", "rows")], scope="track")


def finish_minus_grid(sp: DataFrame, facts: DataFrame) -> DataFrame:
    """finish - grid (dnf = 0, both known): season and career mean / count."""
    out = prior_stats(sp, facts, ["driver_id"], [
        Agg("driver_finish_minus_grid_avg_season_prior", "avg", "fmg"),
        Agg("driver_finish_minus_grid_count_season_prior", "count", "fmg")], scope="season")
    out = prior_stats(out, facts, ["driver_id"], [
        Agg("driver_finish_minus_grid_avg_career_prior", "avg", "fmg"),
        Agg("driver_finish_minus_grid_count_career_prior", "count", "fmg")], scope="career")
    return out


def build_baseline(sp: DataFrame, facts: DataFrame, entries: DataFrame) -> DataFrame:
    """every baseline prior on the spine, in the 40-column contract.

    The spine is written down once with a number for each row. Priors run on its narrow key columns alone, those of one window
    key in one pass ((driver, season) gives F3 + F6 + F11-season, (driver) career gives F7 + F11-career), group priors
    on the distinct grid of groups and periods, and all come back to the wide rows by the row number: one shuffle key.
    """
    wide = staged(sp.withColumn("__row", F.monotonically_increasing_id()), "baseline-spine")
    narrow = wide.select("__row", "season", "round", "driver_id", "constructor_id", "circuit_id", "track_type")
    season = prior_stats(narrow, facts, ["driver_id"], [
        Agg("driver_season_quali_count_prior", "count", Q),
        Agg("driver_q_avg_pos_season_prior", "avg", Q),
        Agg("driver_q_med_pos_season_prior", "median", Q),
        Agg("driver_q_best_pos_season_prior", "min", Q, "bigint"),
        Agg("driver_q_worst_pos_season_prior", "max", Q, "bigint"),
        Agg("driver_season_race_starts_prior", "rows"),
        Agg("__dnfs", "sum", "dnf"),
        Agg("driver_finish_minus_grid_avg_season_prior", "avg", "fmg"),
        Agg("driver_finish_minus_grid_count_season_prior", "count", "fmg"),
    ], scope="season")
    season = season.withColumns({
        "driver_season_dnfs_prior": F.coalesce(F.col("__dnfs"), F.lit(0)).cast("bigint"),
        "driver_season_dnf_rate_prior": F.col("__dnfs") / F.when(
            F.col("driver_season_race_starts_prior") > 0, F.col("driver_season_race_starts_prior")),
    }).drop("__dnfs")
    career = prior_stats(narrow, facts, ["driver_id"], [
        Agg("driver_career_quali_count_prior", "count", Q),
        Agg("driver_q_avg_pos_career_prior", "avg", Q),
        Agg("driver_finish_minus_grid_avg_career_prior", "avg", "fmg"),
        Agg("driver_finish_minus_grid_count_career_prior", "count", "fmg")], scope="career")
    place = circuit_form(narrow, facts, "driver")
    kind = prior_stats(narrow, facts, ["driver_id", "track_type"], DRIVER_TRACK_TYPE, scope="track")
    mate = teammate_delta(narrow, facts)
    families = [season, career, place, kind, tenure(narrow, entries), mate, group_forms(narrow, facts)]
    out = wide
    for family in families:
        new = [c for c in family.columns if c not in narrow.columns]
        out = out.join(family.select("__row", *new), "__row", "left")
    out = out.withColumns({"checkpoint": F.lit("baseline"), "session_type": F.lit("Q")})
    return enforce(out, BASELINE_CONTRACT)


def group_forms(narrow: DataFrame, facts: DataFrame) -> DataFrame:
    """F4, F7, F8 and F9 of the constructors: all on one grid of distinct (constructor, place, period), joined to the rows once."""
    at = ["constructor_id", "circuit_id", "track_type", "season", "round"]
    grid = narrow.select(*at).where(F.col("constructor_id").isNotNull()).distinct()
    for keys, aggs, scope in ((["constructor_id"], GROUP_SEASON, "season"), (["constructor_id"], GROUP_CAREER, "career"),
                              (["constructor_id", "circuit_id"], GROUP_CIRCUIT, "track"), (["constructor_id", "track_type"], GROUP_TRACK_TYPE, "track")):
        grid = prior_stats(grid, facts, keys, aggs, scope)
    met = narrow.alias("n").join(grid.alias("g"), reduce(lambda x, y: x & y, [F.col(f"n.{c}").eqNullSafe(F.col(f"g.{c}")) for c in at]), "left")
    every = [*GROUP_SEASON, *GROUP_CAREER, *GROUP_CIRCUIT, *GROUP_TRACK_TYPE]
    zero = [F.coalesce(F.col(f"g.{a.out}"), F.lit(0).cast("bigint")).alias(a.out) if a.kind == "count" else F.col(f"g.{a.out}") for a in every]
    return met.select("n.__row", *zero)


def features_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """F12 as a stored, season-partitioned table: training and scoring frames read it with pruning."""

    def build() -> DataFrame:
        sp, facts = baseline_inputs(spark, sf)
        # the entries are the spine's own rows: no second scan of the carriers
        return build_baseline(sp, facts, sp.select("season", "round", "driver_id", "constructor_id"))

    return enforce(K.stored(spark, sf, "features_baseline", build), BASELINE_CONTRACT)


# ---------------------------------------------------------------------------
# F13 - F17 building blocks
# ---------------------------------------------------------------------------
def attach_practice(frame: DataFrame, practice: DataFrame,
                    keys: tuple[str, ...] = ("season", "round", "driver_id")) -> DataFrame:
    """practice features at the round; sessions 0-filled; when the round has
    any practice, entities with 0 sessions are dropped. The per-round flag is a
    grouped aggregate joined back, not a window, so a crowded round stays split."""
    keys = list(keys)
    out = frame.join(practice, keys, "left").withColumn(
        "practice_sessions", F.coalesce(F.col("practice_sessions"), F.lit(0)))
    has = practice.groupBy("season", "round").agg(F.max("practice_sessions").alias("__has"))
    out = out.join(has, ["season", "round"], "left")
    return out.where((F.col("practice_sessions") > 0) | (F.coalesce(F.col("__has"), F.lit(0)) == 0)).drop("__has")


def attach_override(spine: DataFrame, other: DataFrame, group: str = "constructor_id",
                    keys: tuple[str, ...] = ("season", "round", "driver_id")) -> DataFrame:
    """Left-join a round table by entity; its group overrides the spine's when present."""
    o = other.withColumnRenamed(group, "__g")
    out = spine.join(o, list(keys), "left")
    return out.withColumn(group, F.coalesce(F.col("__g"), F.col(group))).drop("__g")


def round_group_delta(df: DataFrame, value: str, out: str, group: str = "constructor_id") -> DataFrame:
    """own value minus the group's mean in the round (self included)."""
    m = df.groupBy("season", "round", group).agg(F.avg(value).alias("__gm"))
    return df.join(m, ["season", "round", group], "left") \
        .withColumn(out, F.col(value) - F.col("__gm")).drop("__gm")
