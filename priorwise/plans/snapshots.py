"""K5: raw nested snapshot documents built from the carriers.

The documents are made by Spark from K1/K2 and written as line-delimited
JSON under ``season=YYYY`` folders in the shared checkpoint location; the
canonical jobs (S1, S2, C1-C8) then read them back. Every result document
is one API *page* of at most ``PAGE_LIMIT`` rows of one race, so no document
grows with the data: a race with more rows straddles several pages and the
season ``total`` / page ``offset`` fields tell the reader what to expect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorwise.plans import carriers as K
from priorwise.session import scratch_path

# Fixed values of the snapshot carrier.
PAGE_LIMIT = 30
DNF_STATUSES = ["Engine", "Collision", "Accident", "Gearbox", "Did not start", "Disqualified",
                "Retired", "Power Unit", "", "Spun  off"]
EMPTY_DRIVER_MOD = 29        # (driver + round) % 29 = 0 -> empty driver id (quarantined)
EMPTY_CONSTRUCTOR_MOD = 31   # (driver + round) % 31 = 0 -> blank constructor id (quarantined)
QTIME_EDGE = {0: "1:2.5", 1: "59.123", 2: "1:23"}   # driver % 7 -> literal Q1 text
EMPTY_SEASON = 1994          # a season whose result pages announce total 0

_CACHE: dict[tuple[str, str], str] = {}


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def dnf_status() -> Column:
    arr = F.array(*[F.lit(s) for s in DNF_STATUSES])
    idx = ((F.col("driver_id") + F.col("round")) % len(DNF_STATUSES)).cast("int")
    return F.when(F.col("dnf") == 0, F.when(F.col("driver_id") % 5 == 0, "+1 Lap").otherwise("Finished")) \
        .otherwise(F.element_at(arr, idx + 1))


def _driver_ref() -> Column:
    bad = (F.col("driver_id") + F.col("round")) % EMPTY_DRIVER_MOD == 0
    return F.struct(F.when(bad, F.lit("")).otherwise(_s("driver_id")).alias("driverId"))


def _constructor_ref() -> Column:
    bad = (F.col("driver_id") + F.col("round")) % EMPTY_CONSTRUCTOR_MOD == 0
    return F.struct(F.when(bad, F.lit(" ")).otherwise(_s("constructor_id")).alias("constructorId"))


def qtext(ms: Column) -> Column:
    """m:ss.fff text of a lap time in milliseconds."""
    return F.format_string("%d:%02d.%03d", (ms / 60000).cast("int"),
                           ((ms % 60000) / 1000).cast("int"), (ms % 1000).cast("int"))


def _race_struct(results_field: str, results: Column) -> Column:
    return F.struct(
        _s("season").alias("season"), _s("round").alias("round"),
        F.col("race_name").alias("raceName"),
        F.struct(_s("circuit_id").alias("circuitId"),
                 F.format_string("Circuit %d", "circuit_id").alias("circuitName")).alias("Circuit"),
        F.col("race_date").alias("date"),
        results.alias(results_field))


def _pages(rows: DataFrame, item: Column, results_field: str, change=None) -> DataFrame:
    """Group result rows into page documents of <= PAGE_LIMIT rows of one race. ``change``: of the pages, to plant faults."""
    rows = rows.withColumn("page", F.floor((F.col("ord") - 1) / PAGE_LIMIT))
    pages = rows.groupBy("season", "round", "page", "race_name", "circuit_id", "race_date").agg(
        F.sort_array(F.collect_list(F.struct(F.col("ord"), item.alias("item")))).alias("items"),
        F.count(F.lit(1)).alias("n"))
    # rows of earlier rounds: a window over the calendar's rounds only; pages before this one are full
    rounds = rows.groupBy("season", "round").agg(F.count(F.lit(1)).alias("r"))
    w_off = Window.partitionBy("season").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.withColumn("before", F.coalesce(F.sum("r").over(w_off), F.lit(0))).drop("r")
    totals = rows.groupBy("season").agg(F.count(F.lit(1)).alias("total"))
    pages = pages.join(rounds, ["season", "round"]).join(totals, "season") \
        .withColumn("offset", F.col("before") + F.col("page") * PAGE_LIMIT)
    pages = change(pages) if change else pages
    race = _race_struct(results_field, F.transform("items", lambda x: x["item"]))
    doc = F.struct(F.struct(
        F.lit(str(PAGE_LIMIT)).alias("limit"), _s("offset").alias("offset"), _s("total").alias("total"),
        F.struct(_s("season").alias("season"), F.array(race).alias("Races")).alias("RaceTable"),
    ).alias("MRData"))
    return pages.select("season", F.to_json(doc).alias("value"))


def results_pages(k1: DataFrame, k2: DataFrame, change=None) -> DataFrame:
    r = k1.join(k2, ["season", "round"])
    item = F.struct(
        _s("finish_position").alias("position"),  # non-finishers have none
        F.when(F.col("dnf") == 0, _s("finish_position")).otherwise(F.lit("R")).alias("positionText"),
        _s(F.when(F.col("finish_position").isNotNull(),
                  F.greatest(F.lit(0), 26 - F.col("finish_position"))).otherwise(0)).alias("points"),
        _s("grid_position").alias("grid"),
        F.when(F.col("dnf") == 0, "50").otherwise("20").alias("laps"),
        dnf_status().alias("status"),
        _driver_ref().alias("Driver"), _constructor_ref().alias("Constructor"),
        F.when(F.col("dnf") == 0, F.struct(_s("rev").alias("millis"))).alias("Time"))
    return _pages(r.withColumn("ord", F.col("qualifying_position")), item, "Results", change)


def quali_pages(k1: DataFrame, k2: DataFrame) -> DataFrame:
    r = k1.join(k2, ["season", "round"])
    base_ms = 60000 + F.col("rev") % 40000
    q1 = F.coalesce(*[F.when(F.col("driver_id") % 7 == k, F.lit(v)) for k, v in QTIME_EDGE.items()],
                    qtext(base_ms))
    item = F.struct(
        _s("qualifying_position").alias("position"),
        q1.alias("Q1"),
        F.when(F.col("qualifying_position") <= 15, qtext(base_ms - 500)).otherwise(F.lit("")).alias("Q2"),
        F.when(F.col("qualifying_position") <= 10, qtext(base_ms - 900)).alias("Q3"),
        _driver_ref().alias("Driver"), _constructor_ref().alias("Constructor"))
    return _pages(r.withColumn("ord", F.col("qualifying_position")), item, "QualifyingResults")


def sprint_pages(spark: SparkSession, k9: DataFrame, k2: DataFrame) -> DataFrame:
    r = k9.join(k2, ["season", "round"])
    item = F.struct(
        _s("finish_position").alias("position"),
        F.when(F.col("dnf") == 0, _s("finish_position")).otherwise(F.lit("R")).alias("positionText"),
        _s("points").alias("points"), _s("grid_position").alias("grid"),
        F.when(F.col("dnf") == 0, "17").otherwise("5").alias("laps"),
        F.when(F.col("dnf") == 0, F.lit("Finished")).otherwise(dnf_status()).alias("status"),
        _driver_ref().alias("Driver"), _constructor_ref().alias("Constructor"))
    pages = _pages(r.withColumn("ord", F.col("grid_position")), item, "SprintResults")
    empty = spark.createDataFrame(
        [(EMPTY_SEASON, '{"MRData":{"limit":"30","offset":"0","total":"0",'
                        '"RaceTable":{"season":"%d","Races":[]}}}' % EMPTY_SEASON)],
        "season int, value string")
    return pages.unionByName(empty)


def calendar_docs(k2: DataFrame) -> DataFrame:
    """One calendar document per season (bounded by the rounds of a season)."""
    rd = F.to_date("race_date")

    def d(days: int) -> Column:
        return F.struct(F.date_format(F.date_sub(rd, days), "yyyy-MM-dd").alias("date"))

    sprint_via_quali = F.col("round") % 8 == 0
    race = F.struct(
        F.col("round").alias("ord"),
        F.struct(
            _s("season").alias("season"), _s("round").alias("round"), F.col("race_name").alias("raceName"),
            F.struct(_s("circuit_id").alias("circuitId"),
                     F.format_string("Circuit %d", "circuit_id").alias("circuitName"),
                     F.struct(F.format_string("Town %d", "circuit_id").alias("locality"),
                              F.lit("Nowhere").alias("country")).alias("Location")).alias("Circuit"),
            F.col("race_date").alias("date"),
            d(2).alias("FirstPractice"), d(2).alias("SecondPractice"),
            F.when(F.col("sprint_date").isNull(), d(1)).alias("ThirdPractice"),
            d(1).alias("Qualifying"),
            F.when(F.col("sprint_date").isNotNull(),
                   F.struct(F.when(sprint_via_quali, F.lit("")).otherwise(F.col("sprint_date")).alias("date")))
             .alias("Sprint"),
            F.when(F.col("sprint_date").isNotNull() & sprint_via_quali,
                   F.struct(F.col("sprint_date").alias("date"))).alias("SprintQualifying"),
        ).alias("race"))
    docs = k2.groupBy("season").agg(F.sort_array(F.collect_list(race)).alias("races"))
    doc = F.struct(F.struct(F.struct(_s("season").alias("season"),
                                     F.transform("races", lambda x: x["race"]).alias("Races")).alias("RaceTable"))
                   .alias("MRData"))
    return docs.select("season", F.to_json(doc).alias("value"))


def driver_docs(k1: DataFrame) -> DataFrame:
    """Driver list pages per season (<= PAGE_LIMIT drivers per document)."""
    d = k1.select("season", "driver_id").distinct()
    num = (F.when(F.col("driver_id") % 6 == 0, F.format_string(" %d ", "driver_id"))
           .when(F.col("driver_id") % 6 == 1, F.lit("1.5"))
           .when(F.col("driver_id") % 6 == 2, F.lit(""))
           .when(F.col("driver_id") % 6 == 3, F.lit("x7"))
           .otherwise(_s(F.col("driver_id") % 100)))
    item = F.struct(_s("driver_id").alias("driverId"), num.alias("permanentNumber"),
                    F.format_string("D%03d", F.col("driver_id") % 1000).alias("code"),
                    F.format_string("Given%d", "driver_id").alias("givenName"),
                    F.format_string("Family%d", "driver_id").alias("familyName"),
                    F.when(F.col("driver_id") % 4 != 0, F.lit("1990-01-01")).alias("dateOfBirth"),
                    F.when(F.col("driver_id") % 3 != 0, F.lit("Nowhere")).alias("nationality"))
    d = d.withColumn("page", F.floor(F.col("driver_id") / PAGE_LIMIT))
    g = d.groupBy("season", "page").agg(
        F.sort_array(F.collect_list(F.struct(F.col("driver_id").alias("ord"), item.alias("item")))).alias("items"))
    doc = F.struct(F.struct(F.struct(_s("season").alias("season"),
                                     F.transform("items", lambda x: x["item"]).alias("Drivers")).alias("DriverTable"))
                   .alias("MRData"))
    return g.select("season", F.to_json(doc).alias("value"))


def constructor_docs(k1: DataFrame) -> DataFrame:
    c = k1.select("season", "constructor_id").distinct()
    item = F.struct(_s("constructor_id").alias("constructorId"),
                    F.format_string("Team %d", "constructor_id").alias("name"),
                    F.when(F.col("constructor_id") % 2 == 0, F.lit("Somewhere")).alias("nationality"))
    g = c.groupBy("season").agg(
        F.sort_array(F.collect_list(F.struct(F.col("constructor_id").alias("ord"), item.alias("item")))).alias("items"))
    doc = F.struct(F.struct(F.struct(F.transform("items", lambda x: x["item"]).alias("Constructors"))
                            .alias("ConstructorTable")).alias("MRData"))
    return g.select("season", F.to_json(doc).alias("value"))


def circuit_docs(k2: DataFrame) -> DataFrame:
    c = k2.select("season", "circuit_id").distinct()
    lat = (F.when(F.col("circuit_id") == 0, F.lit(" 45.5 ")).when(F.col("circuit_id") == 1, F.lit("bad"))
           .when(F.col("circuit_id") == 2, F.lit("")).otherwise(F.format_string("%d.25", "circuit_id")))
    lon = F.when(F.col("circuit_id") == 3, F.lit(None)).otherwise(F.format_string("-%d.5", "circuit_id"))
    item = F.struct(_s("circuit_id").alias("circuitId"),
                    F.format_string("http://example.invalid/c%d", "circuit_id").alias("url"),
                    F.format_string("Circuit %d", "circuit_id").alias("circuitName"),
                    F.struct(lat.alias("lat"), lon.alias("long"),
                             F.format_string("Town %d", "circuit_id").alias("locality"),
                             F.lit("Nowhere").alias("country")).alias("Location"))
    g = c.groupBy("season").agg(
        F.sort_array(F.collect_list(F.struct(F.col("circuit_id").alias("ord"), item.alias("item")))).alias("items"))
    doc = F.struct(F.struct(F.struct(F.transform("items", lambda x: x["item"]).alias("Circuits"))
                            .alias("CircuitTable")).alias("MRData"))
    return g.select("season", F.to_json(doc).alias("value"))


KINDS = ["results", "qualifying", "sprint", "races", "drivers", "constructors", "circuits"]


def ensure_snapshots(spark: SparkSession, sf_dir: str) -> str:
    """Write all K5 document sets once per session; return their root folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _CACHE:
        return _CACHE[key]
    root = scratch_path(spark, "snapshots")
    k1 = K.results(spark, sf_dir)
    k2 = K.weekends(spark, sf_dir)
    k9 = K.sprint_results(spark, sf_dir, k1)
    sets = {
        "results": results_pages(k1, k2),
        "qualifying": quali_pages(k1, k2),
        "sprint": sprint_pages(spark, k9, k2),
        "races": calendar_docs(k2),
        "drivers": driver_docs(k1),
        "constructors": constructor_docs(k1),
        "circuits": circuit_docs(k2),
    }
    for name, df in sets.items():
        df.write.mode("overwrite").partitionBy("season").text(f"{root}/{name}")
    _CACHE[key] = root
    return root
