"""Carrier views: the motorsport concepts laid over the driver's tables.

Each carrier has a Spark builder (DataFrame API, reads whole tables) and an
equivalent DuckDB SQL fragment used by the oracle queries. Both sides follow
the same definitions:

K1 results   lineitem x orders -> one row per (season, round, driver)
             season = year(o_orderdate), round = month(o_orderdate),
             driver = l_suppkey, constructor = (driver + 3*season) % 10,
             qualifying_position = row_number by quantity desc, driver,
             rev = sum of integer cents, dnf = more than half the lines 'R',
             finish_position = row_number by rev desc among dnf = 0,
             grid_position = qualifying_position
K2 weekends  one row per (season, round) of orders; circuit = (5*round + season) % 6,
             race_date = first order date, sprint weekend when round % 4 = 0
K3 entries   K1 pairs minus (driver + round) % 17 = 0, plus one entry-only
             driver (-round) per weekend
K4 laps      events: driver = user_id, season = 1995 + day % 7, round = hour % 12 + 1,
             click, purchase -> FP1; view, error -> FP2; signup -> FP3; lap ms = value * 1000
K8 predictions  score = season-prior mean qualifying position (F3)
K9 sprint    K1 rows with round % 4 = 0, finish by quantity asc
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions.exprs import seconds_to_ms
from priorwise.operators.ranking import numbered
from priorwise.session import scratch_path
from priorwise.sources.tables import table

# Fixed values of the carrier definitions.
N_GROUPS = 10          # constructors per season
N_CONTEXTS = 6         # circuits
ENTRY_GAP_MOD = 17     # (driver + round) % 17 = 0 -> result without entry
SPRINT_EVERY = 4       # sprint weekends: round % 4 = 0
STREET_CIRCUITS = (0, 1)
PERMANENT_CIRCUITS = (2, 3)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A carrier as a season-partitioned canonical table in the shared folder, written once a session.

    Features, training frames and scores read the table: seasons prune, and the input tables are scanned once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        root = scratch_path(spark, f"canonical-{name}")
        df = build()
        # whole seasons together where they are small, a large one split: few files, no hot task
        df.hint("rebalance", "season").write.partitionBy("season").parquet(root)
        _STORED[key] = root
    df = spark.read.parquet(_STORED[key])
    return df.select("season", *[c for c in df.columns if c != "season"])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the stored table of per (season, round, driver) results."""
    return stored(spark, sf_dir, "results", lambda: build_results(spark, sf_dir))


def weekends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the stored calendar."""
    return stored(spark, sf_dir, "weekends", lambda: build_weekends(spark, sf_dir))


def build_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: per (season, round, driver) results from lineitem joined to orders."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = li.join(od, li.l_orderkey == od.o_orderkey)
    per = lines.groupBy(
        F.year("o_orderdate").alias("season"),
        F.month("o_orderdate").alias("round"),
        F.col("l_suppkey").alias("driver_id"),
    ).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("rev"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_r"),
    )
    per = per.withColumns({
        "constructor_id": ((F.col("driver_id") + 3 * F.col("season")) % N_GROUPS).cast("bigint"),
        "dnf": (2 * F.col("n_r") > F.col("n_lines")).cast("int"),
    })
    per = numbered(per, ["season", "round"], [F.col("qty").desc(), F.col("driver_id")], "qualifying_position")
    per = numbered(per, ["season", "round", "dnf"], [F.col("rev").desc(), F.col("driver_id")], "finish_position")
    per = per.withColumn("finish_position", F.when(F.col("dnf") == 0, F.col("finish_position")))
    return per.select(
        "season", "round", "driver_id", "constructor_id", "qualifying_position",
        F.col("qualifying_position").alias("grid_position"), "finish_position", "dnf", "rev", "qty")


def build_weekends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: one row per (season, round) with weekend id, circuit and dates."""
    od = table(spark, sf_dir, "orders").select("o_orderdate")
    wk = od.groupBy(
        F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round")
    ).agg(F.min("o_orderdate").alias("first_ts"))
    race_date = F.to_date("first_ts")
    return wk.select(
        "season", "round",
        F.format_string("%d-%02d", "season", "round").alias("weekend_id"),
        F.format_string("Race %d-%02d", "season", "round").alias("race_name"),
        ((F.col("round") * 5 + F.col("season")) % N_CONTEXTS).cast("int").alias("circuit_id"),
        F.date_format(race_date, "yyyy-MM-dd").alias("race_date"),
        F.when(F.col("round") % SPRINT_EVERY == 0,
               F.date_format(F.date_sub(race_date, 1), "yyyy-MM-dd")).alias("sprint_date"),
    )


def track_types(spark: SparkSession) -> DataFrame:
    """Circuit -> track type mapping (a configuration table; unmapped circuits absent)."""
    rows = [(c, "STREET") for c in STREET_CIRCUITS] + [(c, "PERMANENT") for c in PERMANENT_CIRCUITS]
    return spark.createDataFrame(rows, "circuit_id int, track_type string")


def weekend_track_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping by weekend id (the ``by_weekend_id`` shape) derived from K2."""
    return (weekends(spark, sf_dir).join(track_types(spark), "circuit_id")
            .select("weekend_id", "track_type"))


def entries(spark: SparkSession, sf_dir: str, k1: DataFrame | None = None,
            k2: DataFrame | None = None) -> DataFrame:
    """K3: participation spine (season, round, driver, constructor, circuit, race_date)."""
    k1 = k1 if k1 is not None else results(spark, sf_dir)
    k2 = k2 if k2 is not None else weekends(spark, sf_dir)
    from_results = k1.where((F.col("driver_id") + F.col("round")) % ENTRY_GAP_MOD != 0) \
        .select("season", "round", "driver_id", "constructor_id")
    entry_only = k2.select(
        "season", "round", (-F.col("round")).cast("bigint").alias("driver_id"),
        (F.col("round") % N_GROUPS).cast("bigint").alias("constructor_id"))
    pairs = from_results.unionByName(entry_only)
    wk = k2.select("season", "round", "circuit_id", "race_date")
    return pairs.join(wk, ["season", "round"])


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: lap rows per (round, session, driver); null lap every 13th event, in/out laps when k % 10 = 0."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ev.select(
        (F.lit(1995) + F.dayofmonth("ts") % 7).cast("int").alias("season"),
        (F.hour("ts") % 12 + 1).cast("int").alias("round"),
        F.when(F.col("event_type").isin("click", "purchase"), "FP1").when(F.col("event_type").isin("view", "error"), "FP2")
         .otherwise("FP3").alias("session_type"),
        F.col("user_id").alias("driver_id"),
        F.col("event_id"),
        F.when(F.col("event_id") % 13 != 0, seconds_to_ms("value")).alias("lap_time_ms"),
        (k % 10 == 0).alias("in_out"),
    )


def session_results(spark: SparkSession, sf_dir: str, k4: DataFrame | None = None) -> DataFrame:
    """K4 session results: reported best = slowest kept lap (NULL when (driver + round) % 4 = 0),
    reported position = driver % 20 + 1 except on rounds divisible by 5 (no positions)."""
    k4 = k4 if k4 is not None else laps(spark, sf_dir)
    g = k4.groupBy("season", "round", "session_type", "driver_id").agg(F.max("lap_time_ms").alias("__mx"))
    return g.select(
        "season", "round", "session_type", "driver_id",
        F.when((F.col("driver_id") + F.col("round")) % 4 != 0, F.col("__mx")).alias("best_lap_time_ms"),
        F.when(F.col("round") % 5 != 0, F.col("driver_id") % 20 + 1).cast("bigint").alias("position"))


def sprint_results(spark: SparkSession, sf_dir: str, k1: DataFrame | None = None) -> DataFrame:
    """K9: sprint results on rounds divisible by 4, finish by quantity ascending."""
    k1 = k1 if k1 is not None else results(spark, sf_dir)
    sp = k1.where(F.col("round") % SPRINT_EVERY == 0)
    sp = numbered(sp, ["season", "round", "dnf"], [F.col("qty").asc(), F.col("driver_id")], "__place")
    return sp.select(
        "season", "round", "driver_id", "constructor_id", "grid_position",
        F.when(F.col("dnf") == 0, F.col("__place")).alias("finish_position"),
        "dnf",
        F.when(F.col("dnf") == 0, 8 - F.col("__place")).cast("double").alias("points_raw"),
    ).withColumn("points", F.greatest(F.col("points_raw"), F.lit(0.0))).drop("points_raw")


# ---------------------------------------------------------------------------
# DuckDB SQL of the same carriers (used by the oracle queries).
# ---------------------------------------------------------------------------

K1_SQL = f"""
k1_agg AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS season,
         CAST(month(o.o_orderdate) AS INTEGER) AS round,
         l.l_suppkey AS driver_id,
         sum(CAST(l.l_quantity AS BIGINT)) AS qty,
         sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS rev,
         count(*) AS n_lines,
         sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2, 3
),
k1_base AS (
  SELECT *, CAST((driver_id + 3 * season) % {N_GROUPS} AS BIGINT) AS constructor_id,
         CAST(CASE WHEN 2 * n_r > n_lines THEN 1 ELSE 0 END AS INTEGER) AS dnf
  FROM k1_agg
),
k1 AS (
  SELECT season, round, driver_id, constructor_id,
         CAST(row_number() OVER (PARTITION BY season, round ORDER BY qty DESC, driver_id) AS BIGINT)
           AS qualifying_position,
         CAST(row_number() OVER (PARTITION BY season, round ORDER BY qty DESC, driver_id) AS BIGINT)
           AS grid_position,
         CAST(CASE WHEN dnf = 0 THEN row_number() OVER (PARTITION BY season, round, dnf
              ORDER BY rev DESC, driver_id) END AS BIGINT) AS finish_position,
         dnf, rev, qty
  FROM k1_base
)"""

K2_SQL = f"""
k2 AS (
  SELECT season, round,
         printf('%d-%02d', season, round) AS weekend_id,
         printf('Race %d-%02d', season, round) AS race_name,
         CAST((round * 5 + season) % {N_CONTEXTS} AS INTEGER) AS circuit_id,
         strftime(first_ts, '%Y-%m-%d') AS race_date,
         CASE WHEN round % {SPRINT_EVERY} = 0
              THEN strftime(CAST(first_ts AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') END AS sprint_date
  FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS season,
               CAST(month(o_orderdate) AS INTEGER) AS round,
               min(o_orderdate) AS first_ts
        FROM orders GROUP BY 1, 2) t
),
k2_tt AS (
  SELECT * FROM (VALUES {", ".join(f"({c}, 'STREET')" for c in STREET_CIRCUITS)},
                        {", ".join(f"({c}, 'PERMANENT')" for c in PERMANENT_CIRCUITS)})
    AS t(circuit_id, track_type)
),
k2_ttw AS (
  SELECT w.weekend_id, t.track_type FROM k2 w JOIN k2_tt t ON w.circuit_id = t.circuit_id
)"""

K3_SQL = f"""
k3 AS (
  SELECT p.season, p.round, p.driver_id, p.constructor_id, w.circuit_id, w.race_date
  FROM (SELECT season, round, driver_id, constructor_id FROM k1
        WHERE (driver_id + round) % {ENTRY_GAP_MOD} <> 0
        UNION ALL
        SELECT season, round, CAST(-round AS BIGINT), CAST(round % {N_GROUPS} AS BIGINT) FROM k2) p
  JOIN k2 w ON p.season = w.season AND p.round = w.round
)"""

K4_SQL = """
k4 AS (
  SELECT CAST(1995 + dayofmonth(ts) % 7 AS INTEGER) AS season,
         CAST(hour(ts) % 12 + 1 AS INTEGER) AS round,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'FP1' WHEN event_type IN ('view', 'error') THEN 'FP2'
              ELSE 'FP3' END
           AS session_type,
         user_id AS driver_id, event_id,
         CASE WHEN event_id % 13 <> 0 THEN value * 1000 END AS lap_time_ms,
         (TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0) AS in_out
  FROM events
)"""

K4S_SQL = """
k4s AS (
  SELECT season, round, session_type, driver_id,
         CASE WHEN (driver_id + round) % 4 = 0 THEN NULL ELSE max(lap_time_ms) END AS best_lap_time_ms,
         CAST(CASE WHEN round % 5 = 0 THEN NULL ELSE driver_id % 20 + 1 END AS BIGINT) AS position
  FROM k4 GROUP BY 1, 2, 3, 4
)"""

K9_SQL = f"""
k9 AS (
  SELECT season, round, driver_id, constructor_id, grid_position,
         CAST(CASE WHEN dnf = 0 THEN row_number() OVER (PARTITION BY season, round, dnf
              ORDER BY qty ASC, driver_id) END AS BIGINT) AS finish_position,
         dnf,
         greatest(CAST(CASE WHEN dnf = 0 THEN 8 - row_number() OVER (PARTITION BY season, round, dnf
              ORDER BY qty ASC, driver_id) END AS DOUBLE), 0.0) AS points
  FROM k1 WHERE round % {SPRINT_EVERY} = 0
)"""


def with_carriers(body: str, *names: str) -> str:
    """Prefix ``body`` with the carrier CTEs it needs (k1, k2, k3, k4, k9)."""
    parts = []
    need = set(names)
    if need & {"k3", "k9"}:
        need.add("k1")
    if "k3" in need:
        need.add("k2")
    if "k1" in need:
        parts.append(K1_SQL)
    if "k2" in need:
        parts.append(K2_SQL)
    if "k3" in need:
        parts.append(K3_SQL)
    if "k4s" in need:
        need.add("k4")
    if "k4" in need:
        parts.append(K4_SQL)
    if "k4s" in need:
        parts.append(K4S_SQL)
    if "k9" in need:
        parts.append(K9_SQL)
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body
