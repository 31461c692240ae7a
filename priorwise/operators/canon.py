"""Canonicalisation (C1-C8): nested snapshot records -> typed flat tables.

Everything is projection, ``explode`` and filters on the scan, so it runs
as narrow map stages over the snapshot files (no shuffle before the write).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwise.functions.exprs import category_of, laptime_ms, normalize_status, safe_float, safe_int
from priorwise.sources.snapshot import page_rows, records


def _blank_null(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s != "", c)


def canon_weekends(snap: DataFrame) -> DataFrame:
    """One row per race with weekend id SSSS-RR and the session dates.

    Sprint date = Sprint.date, else SprintQualifying.date (an empty string
    counts as missing).
    """
    r = records(snap, "races")
    rnd = safe_int(F.col("rec.round"))
    return r.select(
        "season", rnd.alias("round"),
        F.format_string("%d-%02d", F.col("season"), rnd).alias("weekend_id"),
        F.col("rec.raceName").alias("race_name"),
        F.col("rec.Circuit.circuitId").alias("circuit_id"),
        F.col("rec.Circuit.circuitName").alias("circuit_name"),
        F.col("rec.Circuit.Location.locality").alias("locality"),
        F.col("rec.Circuit.Location.country").alias("country"),
        _blank_null(F.col("rec.date")).alias("race_date"),
        _blank_null(F.col("rec.FirstPractice.date")).alias("fp1_date"),
        _blank_null(F.col("rec.SecondPractice.date")).alias("fp2_date"),
        _blank_null(F.col("rec.ThirdPractice.date")).alias("fp3_date"),
        _blank_null(F.col("rec.Qualifying.date")).alias("qualifying_date"),
        F.coalesce(_blank_null(F.col("rec.Sprint.date")),
                   _blank_null(F.col("rec.SprintQualifying.date"))).alias("sprint_date"),
        F.lit("snapshot").alias("source"), "source_path",
    ).where(F.col("round").isNotNull())


def canon_circuits(snap: DataFrame) -> DataFrame:
    """Circuits with Location flattened; lat/long parsed as safe floats."""
    r = records(snap, "circuits")
    return r.select(
        "season", F.col("rec.circuitId").alias("circuit_id"),
        F.col("rec.circuitName").alias("circuit_name"),
        F.col("rec.Location.locality").alias("locality"), F.col("rec.Location.country").alias("country"),
        safe_float(F.col("rec.Location.lat")).alias("lat"), safe_float(F.col("rec.Location.long")).alias("long"),
        F.col("rec.url").alias("url"), F.lit("snapshot").alias("source"), "source_path")


def canon_drivers(snap: DataFrame) -> DataFrame:
    """Drivers; permanent number is a safe int, optional strings stay NULL."""
    r = records(snap, "drivers")
    return r.select(
        "season", F.col("rec.driverId").alias("driver_id"),
        safe_int(F.col("rec.permanentNumber")).alias("permanent_number"),
        F.col("rec.code").alias("code"), F.col("rec.givenName").alias("given_name"),
        F.col("rec.familyName").alias("family_name"), F.col("rec.dateOfBirth").alias("date_of_birth"),
        F.col("rec.nationality").alias("nationality"), F.col("rec.url").alias("url"),
        F.lit("snapshot").alias("source"), "source_path")


def canon_constructors(snap: DataFrame) -> DataFrame:
    """C4: constructors."""
    r = records(snap, "constructors")
    return r.select(
        "season", F.col("rec.constructorId").alias("constructor_id"),
        F.col("rec.name").alias("constructor_name"), F.col("rec.nationality").alias("nationality"),
        F.col("rec.url").alias("url"), F.lit("snapshot").alias("source"), "source_path")


def _result_reasons(flat: DataFrame) -> Column:
    """First failing guardrail of a flattened result row, NULL when valid."""
    race = F.col("race")
    return (F.when(safe_int(race.round).isNull(), "race_missing_round")
            .when(_blank_null(race.raceName).isNull(), "race_missing_name")
            .when(_blank_null(race.date).isNull(), "race_missing_date")
            .when(_blank_null(race.Circuit.circuitId).isNull(), "race_missing_circuit")
            .when(F.coalesce(F.trim(F.col("res.Driver.driverId")), F.lit("")) == "", "empty_driver_id")
            .when(F.coalesce(F.trim(F.col("res.Constructor.constructorId")), F.lit("")) == "",
                  "empty_constructor_id"))


def flatten_results(snap: DataFrame, array_field: str = "Results") -> DataFrame:
    """Races x results with a ``reason`` column (NULL = valid) and file order."""
    flat = page_rows(snap, array_field)
    return flat.withColumn("reason", _result_reasons(flat))


def canon_results(snap: DataFrame, sprint: bool = False) -> DataFrame:
    """Typed race (or sprint) results.

    finish_position only when the status is CLASSIFIED; dnf = not
    CLASSIFIED; empty status stored as 'UNKNOWN' after categorising (OTHER).
    """
    field = "SprintResults" if sprint else "Results"
    flat = flatten_results(snap, field).where(F.col("reason").isNull())
    # in steps: each is a column, computed once a row
    flat = flat.withColumn("__status", F.trim(F.coalesce(F.col("res.status"), F.lit("")))) \
        .withColumn("__normal", normalize_status("__status")).withColumn("__cat", category_of("__normal", sprint=sprint))
    status, cat = F.col("__status"), F.col("__cat")
    return flat.select(
        "season", safe_int(F.col("race.round")).alias("round"), F.col("race.raceName").alias("race_name"),
        F.col("race.Circuit.circuitId").alias("circuit_id"), F.col("race.date").alias("race_date"),
        F.col("res.Driver.driverId").alias("driver_id"),
        F.col("res.Constructor.constructorId").alias("constructor_id"),
        safe_int(F.col("res.grid")).alias("grid_position"),
        F.when(cat == "CLASSIFIED", safe_int(F.col("res.position"))).alias("finish_position"),
        F.col("res.positionText").alias("position_text"),
        safe_float(F.col("res.points")).alias("points"),
        safe_int(F.col("res.laps")).alias("laps"),
        safe_int(F.col("res.Time.millis")).alias("time_ms"),
        F.when(status == "", F.lit("UNKNOWN")).otherwise(status).alias("status_raw"),
        cat.alias("status_category"),
        (cat != "CLASSIFIED").alias("dnf"),
        F.lit("snapshot").alias("source"), "source_path",
        "offset", "race_pos", "res_pos",
    )


def canon_quali(snap: DataFrame) -> DataFrame:
    """Typed qualifying results with lap times in milliseconds."""
    flat = flatten_results(snap, "QualifyingResults").where(F.col("reason").isNull())
    cols = [
        "season", safe_int(F.col("race.round")).alias("round"), F.col("race.raceName").alias("race_name"),
        F.col("race.Circuit.circuitId").alias("circuit_id"), F.col("race.date").alias("race_date"),
        F.col("res.Driver.driverId").alias("driver_id"),
        F.col("res.Constructor.constructorId").alias("constructor_id"),
        safe_int(F.col("res.position")).alias("qualifying_position"),
    ]
    for q in ("Q1", "Q2", "Q3"):
        cols.append(F.col(f"res.{q}").alias(f"{q.lower()}_time"))
    for q in ("Q1", "Q2", "Q3"):
        cols.append(laptime_ms(F.col(f"res.{q}")).alias(f"{q.lower()}_ms"))
    cols += [F.lit("snapshot").alias("source"), "source_path", "offset", "race_pos", "res_pos"]
    return flat.select(*cols)


def quarantine_counts(snap: DataFrame, array_field: str = "Results") -> DataFrame:
    """Rows dropped by the guardrails, counted per season and reason."""
    flat = flatten_results(snap, array_field).where(F.col("reason").isNotNull())
    return flat.groupBy("season", "reason").agg(F.count(F.lit(1)).alias("rows"))
