"""Registered queries for the ETL half: snapshot scans (S1, S2), canonical
tables (C1-C9) and the scalar expressions (X1-X4).

Spark side reads the K5 documents back from the shared folder; the oracle
side computes the same flat tables straight from the carriers in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.functions.exprs import laptime_ms, status_category, status_category_sql
from priorwise.functions.schema import enforce
from priorwise.operators import canon as C
from priorwise.plans import carriers as K
from priorwise.plans import snapshots as SN
from priorwise.plans.carriers import with_carriers
from priorwise.plans.registry import big, register
from priorwise.sources.snapshot import page_audit, read_snapshot
from priorwise.sources.tables import table


def _snap(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return read_snapshot(spark, f"{SN.ensure_snapshots(spark, sf)}/{kind}")


_STATUS_LIST_SQL = "[" + ", ".join(f"'{s}'" for s in SN.DNF_STATUSES) + "]"
_DNF_STATUS_SQL = (f"CASE WHEN f.dnf = 0 THEN CASE WHEN f.driver_id % 5 = 0 THEN '+1 Lap' ELSE 'Finished' END "
                   f"ELSE {_STATUS_LIST_SQL}[((f.driver_id + f.round) % {len(SN.DNF_STATUSES)}) + 1] END")
_VALID_SQL = (f"(f.driver_id + f.round) % {SN.EMPTY_DRIVER_MOD} <> 0 "
              f"AND (f.driver_id + f.round) % {SN.EMPTY_CONSTRUCTOR_MOD} <> 0")


# ---------------------------------------------------------------------------
# S1 / S2
# ---------------------------------------------------------------------------
@register("scan_snapshot", with_carriers("""
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, race_name, race_date FROM k2""", "k2"))
def q_scan_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    w = C.canon_weekends(_snap(spark, sf, "races"))
    return w.select(big("season").alias("season"), big("round").alias("round"), "race_name", "race_date")


@register("page_combine_audit", with_carriers(f"""
SELECT CAST(season AS BIGINT) AS season,
       CAST(count(DISTINCT (round, (qualifying_position - 1) // {SN.PAGE_LIMIT})) AS BIGINT) AS pages,
       CAST(count(*) AS BIGINT) AS total, CAST(0 AS BIGINT) AS bad_total_pages,
       CAST(count(*) AS BIGINT) AS rows, CAST(1 AS BIGINT) AS complete
FROM k1 GROUP BY season""", "k1"))
def q_page_combine_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = page_audit(_snap(spark, sf, "results"), "Results")
    return a.select(big("season").alias("season"), big("pages").alias("pages"), big("total").alias("total"),
                    big("bad_total_pages").alias("bad_total_pages"), big("rows").alias("rows"),
                    big("complete").alias("complete"))


@register("sprint_page_audit", with_carriers(f"""
SELECT CAST(season AS BIGINT) AS season,
       CAST(count(DISTINCT (round, (grid_position - 1) // {SN.PAGE_LIMIT})) AS BIGINT) AS pages,
       CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS rows, CAST(1 AS BIGINT) AS complete
FROM k9 GROUP BY season
UNION ALL SELECT {SN.EMPTY_SEASON}, 1, 0, 0, 1""", "k9"))
def q_sprint_page_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = page_audit(_snap(spark, sf, "sprint"), "SprintResults")
    return a.select(big("season").alias("season"), big("pages").alias("pages"), big("total").alias("total"),
                    big("rows").alias("rows"), big("complete").alias("complete"))


# ---------------------------------------------------------------------------
# C1 - C4
# ---------------------------------------------------------------------------
@register("canon_weekends", with_carriers("""
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, weekend_id, race_name,
       CAST(circuit_id AS VARCHAR) AS circuit_id, printf('Circuit %d', circuit_id) AS circuit_name, printf('Town %d', circuit_id) AS locality,
       'Nowhere' AS country, race_date,
       strftime(CAST(race_date AS DATE) - INTERVAL 2 DAY, '%Y-%m-%d') AS fp1_date,
       strftime(CAST(race_date AS DATE) - INTERVAL 2 DAY, '%Y-%m-%d') AS fp2_date,
       strftime(CAST(race_date AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') AS qualifying_date,
       CASE WHEN sprint_date IS NULL THEN strftime(CAST(race_date AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') END
         AS fp3_date,
       sprint_date
FROM k2""", "k2"))
def q_canon_weekends(spark: SparkSession, sf: str) -> DataFrame:
    w = C.canon_weekends(_snap(spark, sf, "races"))
    return w.select(big("season").alias("season"), big("round").alias("round"), "weekend_id", "race_name",
                    "circuit_id", "circuit_name", "locality", "country", "race_date", "fp1_date", "fp2_date", "fp3_date",
                    "qualifying_date", "sprint_date")


@register("canon_dim_float", with_carriers("""
SELECT DISTINCT CAST(season AS BIGINT) AS season, CAST(circuit_id AS VARCHAR) AS circuit_id,
       CASE circuit_id WHEN 0 THEN 45.5 WHEN 1 THEN NULL WHEN 2 THEN NULL
            ELSE CAST(circuit_id AS DOUBLE) + 0.25 END AS lat,
       CASE WHEN circuit_id = 3 THEN NULL ELSE -(CAST(circuit_id AS DOUBLE) + 0.5) END AS long
FROM k2""", "k2"))
def q_canon_dim_float(spark: SparkSession, sf: str) -> DataFrame:
    c = C.canon_circuits(_snap(spark, sf, "circuits"))
    return c.select(big("season").alias("season"), "circuit_id", "lat", "long")


@register("canon_dim_int", with_carriers("""
SELECT DISTINCT CAST(season AS BIGINT) AS season, CAST(driver_id AS VARCHAR) AS driver_id,
       CASE driver_id % 6 WHEN 0 THEN driver_id WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL
            ELSE driver_id % 100 END AS permanent_number,
       printf('D%03d', driver_id % 1000) AS code,
       CASE WHEN driver_id % 4 <> 0 THEN '1990-01-01' END AS date_of_birth,
       CASE WHEN driver_id % 3 <> 0 THEN 'Nowhere' END AS nationality
FROM k1""", "k1"))
def q_canon_dim_int(spark: SparkSession, sf: str) -> DataFrame:
    d = C.canon_drivers(_snap(spark, sf, "drivers"))
    return d.select(big("season").alias("season"), "driver_id", "permanent_number", "code",
                    "date_of_birth", "nationality")


@register("canon_dim_plain", with_carriers("""
SELECT DISTINCT CAST(season AS BIGINT) AS season, CAST(constructor_id AS VARCHAR) AS constructor_id,
       printf('Team %d', constructor_id) AS constructor_name,
       CASE WHEN constructor_id % 2 = 0 THEN 'Somewhere' END AS nationality
FROM k1""", "k1"))
def q_canon_dim_plain(spark: SparkSession, sf: str) -> DataFrame:
    c = C.canon_constructors(_snap(spark, sf, "constructors"))
    return c.select(big("season").alias("season"), "constructor_id", "constructor_name", "nationality")


# ---------------------------------------------------------------------------
# C5 - C8
# ---------------------------------------------------------------------------
_RESULTS_OUT = ["season", "round", "race_name", "circuit_id", "race_date", "driver_id", "constructor_id",
                "grid_position", "finish_position", "position_text", "points", "laps", "time_ms",
                "status_raw", "status_category", "dnf"]


def _results_out(df: DataFrame) -> DataFrame:
    return df.select(big("season").alias("season"), big("round").alias("round"), "race_name", "circuit_id",
                     "race_date", "driver_id", "constructor_id", "grid_position", "finish_position",
                     "position_text", "points", "laps", "time_ms", "status_raw", "status_category",
                     big("dnf").alias("dnf"))


@register("canon_results", with_carriers(f""",
kr AS (
  SELECT f.*, w.race_name, w.circuit_id, w.race_date, {_DNF_STATUS_SQL} AS status0
  FROM k1 f JOIN k2 w USING (season, round)
  WHERE {_VALID_SQL}
),
kc AS (SELECT *, {status_category_sql('status0')} AS cat FROM kr)
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, race_name,
       CAST(circuit_id AS VARCHAR) AS circuit_id, race_date, CAST(driver_id AS VARCHAR) AS driver_id,
       CAST(constructor_id AS VARCHAR) AS constructor_id, grid_position,
       CASE WHEN cat = 'CLASSIFIED' THEN coalesce(finish_position, 500 + qualifying_position) END AS finish_position,
       CASE WHEN dnf = 0 THEN CAST(finish_position AS VARCHAR) ELSE 'R' END AS position_text,
       CAST(CASE WHEN finish_position IS NOT NULL THEN greatest(0, 26 - finish_position) ELSE 0 END AS DOUBLE)
         AS points,
       CAST(CASE WHEN dnf = 0 THEN 50 ELSE 20 END AS BIGINT) AS laps,
       CASE WHEN dnf = 0 THEN rev END AS time_ms,
       CASE WHEN trim(status0) = '' THEN 'UNKNOWN' ELSE trim(status0) END AS status_raw,
       cat AS status_category, CAST(CASE WHEN cat <> 'CLASSIFIED' THEN 1 ELSE 0 END AS BIGINT) AS dnf
FROM kc""", "k1", "k2"))
def q_canon_results(spark: SparkSession, sf: str) -> DataFrame:
    return _results_out(C.canon_results(_snap(spark, sf, "results")))


@register("canon_results_empty_ok", with_carriers(f""",
kr AS (
  SELECT f.*, w.race_name, w.circuit_id, w.race_date,
         CASE WHEN f.dnf = 0 THEN 'Finished'
              ELSE {_STATUS_LIST_SQL}[((f.driver_id + f.round) % {len(SN.DNF_STATUSES)}) + 1] END AS status0
  FROM k9 f JOIN k2 w USING (season, round)
  WHERE {_VALID_SQL}
),
kc AS (SELECT *, {status_category_sql('status0', sprint=True)} AS cat FROM kr)
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, race_name,
       CAST(circuit_id AS VARCHAR) AS circuit_id, race_date, CAST(driver_id AS VARCHAR) AS driver_id,
       CAST(constructor_id AS VARCHAR) AS constructor_id, grid_position,
       CASE WHEN cat = 'CLASSIFIED' THEN coalesce(finish_position, 500 + grid_position) END AS finish_position,
       CASE WHEN dnf = 0 THEN CAST(finish_position AS VARCHAR) ELSE 'R' END AS position_text,
       points, CAST(CASE WHEN dnf = 0 THEN 17 ELSE 5 END AS BIGINT) AS laps,
       CAST(NULL AS BIGINT) AS time_ms,
       CASE WHEN trim(status0) = '' THEN 'UNKNOWN' ELSE trim(status0) END AS status_raw,
       cat AS status_category, CAST(CASE WHEN cat <> 'CLASSIFIED' THEN 1 ELSE 0 END AS BIGINT) AS dnf
FROM kc""", "k9", "k2"))
def q_canon_results_empty_ok(spark: SparkSession, sf: str) -> DataFrame:
    return _results_out(C.canon_results(_snap(spark, sf, "sprint"), sprint=True))


@register("canon_quali", with_carriers(f""",
kq AS (SELECT f.*, 60000 + f.rev % 40000 AS ms FROM k1 f WHERE {_VALID_SQL})
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round,
       CAST(driver_id AS VARCHAR) AS driver_id, CAST(constructor_id AS VARCHAR) AS constructor_id,
       qualifying_position,
       CASE driver_id % 7 WHEN 0 THEN 62500 WHEN 1 THEN 59123 WHEN 2 THEN NULL ELSE ms END AS q1_ms,
       CASE WHEN qualifying_position <= 15 THEN ms - 500 END AS q2_ms,
       CASE WHEN qualifying_position <= 10 THEN ms - 900 END AS q3_ms
FROM kq""", "k1"))
def q_canon_quali(spark: SparkSession, sf: str) -> DataFrame:
    q = C.canon_quali(_snap(spark, sf, "qualifying"))
    return q.select(big("season").alias("season"), big("round").alias("round"), "driver_id", "constructor_id",
                    "qualifying_position", "q1_ms", "q2_ms", "q3_ms")


@register("quarantine_counts", with_carriers(f"""
SELECT CAST(season AS BIGINT) AS season, reason, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT season, CASE WHEN (driver_id + round) % {SN.EMPTY_DRIVER_MOD} = 0 THEN 'empty_driver_id'
                      ELSE 'empty_constructor_id' END AS reason
  FROM k1 WHERE (driver_id + round) % {SN.EMPTY_DRIVER_MOD} = 0
             OR (driver_id + round) % {SN.EMPTY_CONSTRUCTOR_MOD} = 0) t
GROUP BY 1, 2""", "k1"))
def q_quarantine_counts(spark: SparkSession, sf: str) -> DataFrame:
    q = C.quarantine_counts(_snap(spark, sf, "results"))
    return q.select(big("season").alias("season"), "reason", big("rows").alias("rows"))


# ---------------------------------------------------------------------------
# C9 schema contract
# ---------------------------------------------------------------------------
RESULTS_CONTRACT = [("season", "bigint"), ("round", "bigint"), ("driver_id", "string"),
                    ("constructor_id", "string"), ("grid_position", "bigint"), ("finish_position", "bigint"),
                    ("points", "double"), ("status_raw", "string"), ("time_ms", "bigint")]


@register("schema_contract", with_carriers("""
SELECT CAST(season AS BIGINT) AS season, CAST(round AS BIGINT) AS round, CAST(driver_id AS VARCHAR) AS driver_id,
       CAST(constructor_id AS VARCHAR) AS constructor_id, grid_position, finish_position,
       CAST(qty AS DOUBLE) AS points, CAST(NULL AS VARCHAR) AS status_raw,
       CAST(NULL AS BIGINT) AS time_ms
FROM k1""", "k1"))
def q_schema_contract(spark: SparkSession, sf: str) -> DataFrame:
    k1 = K.results(spark, sf).select(
        F.col("season").cast("string").alias("season"), "round", "driver_id", "constructor_id",
        F.col("grid_position").cast("string").alias("grid_position"), "finish_position",
        F.col("qty").alias("points"), F.lit("extra").alias("not_in_contract"))
    return enforce(k1, RESULTS_CONTRACT)


# ---------------------------------------------------------------------------
# X3 / X4 on text from the driver's tables (K6) plus the pinned edge cases
# ---------------------------------------------------------------------------
# Lap-time edge texts and their expected milliseconds.
LAP_EDGES = [("1:2.5", 62500), ("59.123", 59123), ("1:23", None), ("", None), (" 1:23.4567 ", 83456),
             ("0:59.1", 59100), ("abc", None), ("1:23.", 83000), ("12:00.000", 720000)]
# Status texts pinned by the tests.
STATUS_EDGES = ["Finished", "+1 Lap", "Lapped", "Disqualified", "Did not start", "Withdrew",
                "Spun  off", "", "  ", "ERS", "Power loss", "Retired", "Collision damage", "Tyre",
                "Engine fire", "Fuel pressure", "Not classified"]


@register("laptime_ms", f"""
SELECT CAST(doc_id AS BIGINT) AS id, printf('%d:%02d.%03d', (n_chars * 37) // 60000 % 3,
       ((n_chars * 37) % 60000) // 1000, (n_chars * 37) % 1000) AS lap_text,
       CAST(((n_chars * 37) // 60000 % 3) * 60000 + (((n_chars * 37) % 60000) // 1000) * 1000
            + (n_chars * 37) % 1000 AS BIGINT) AS ms
FROM documents
UNION ALL
SELECT * FROM (VALUES {", ".join(f"(CAST({-(i + 1)} AS BIGINT), '{t}', CAST({'NULL' if v is None else v} AS BIGINT))"
                                  for i, (t, v) in enumerate(LAP_EDGES))}) t(id, lap_text, ms)""")
def q_laptime_ms(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    v = F.col("n_chars") * 37
    txt = F.format_string("%d:%02d.%03d", ((v / 60000).cast("bigint") % 3),
                          ((v % 60000) / 1000).cast("bigint"), (v % 1000))
    docs = d.select(big("doc_id").alias("id"), txt.alias("lap_text"))
    edges = spark.createDataFrame([(-(i + 1), t) for i, (t, _) in enumerate(LAP_EDGES)], "id bigint, lap_text string")
    u = docs.unionByName(edges)
    return u.select("id", "lap_text", laptime_ms("lap_text").alias("ms"))


def _status_source(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(big("doc_id").alias("id"),
                                             F.col("text").alias("status_raw"))
    edges = spark.createDataFrame([(-(i + 1), s) for i, s in enumerate(STATUS_EDGES)], "id bigint, status_raw string")
    return d.unionByName(edges)


def _status_sql(sprint: bool) -> str:
    vals = ", ".join(f"(CAST({-(i + 1)} AS BIGINT), '{s}')" for i, s in enumerate(STATUS_EDGES))
    return f"""
WITH src AS (
  SELECT CAST(doc_id AS BIGINT) AS id, text AS status_raw FROM documents
  UNION ALL SELECT * FROM (VALUES {vals}) t(id, status_raw)
)
SELECT id, status_raw, {status_category_sql('status_raw', sprint=sprint)} AS status_category FROM src"""


@register("status_category", _status_sql(False))
def q_status_category(spark: SparkSession, sf: str) -> DataFrame:
    s = _status_source(spark, sf)
    return s.select("id", "status_raw", status_category("status_raw").alias("status_category"))


@register("status_category_sprint", _status_sql(True))
def q_status_category_sprint(spark: SparkSession, sf: str) -> DataFrame:
    s = _status_source(spark, sf)
    return s.select("id", "status_raw", status_category("status_raw", sprint=True).alias("status_category"))
