"""Nested JSON season snapshots and paged result documents.

A snapshot document is ``{"MRData": {...}}`` with every leaf a string. The
reader uses an explicit schema (no inference pass over the data), keeps
file order with ``posexplode`` and recovers ``season`` from the
``season=YYYY`` folder through partition discovery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from priorwise.operators.ranking import running

def _s(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


def _struct(*fields) -> StructType:
    out = []
    for f in fields:
        out.extend(_s(f) if isinstance(f, str) else [f])
    return StructType(out)


LOCATION = _struct("lat", "long", "locality", "country")
CIRCUIT = _struct("circuitId", "url", "circuitName", StructField("Location", LOCATION))
DATE = _struct("date", "time")
DRIVER_REF = _struct("driverId")
CONSTRUCTOR_REF = _struct("constructorId")
RESULT = _struct("number", "position", "positionText", "points", "grid", "laps", "status",
                 StructField("Driver", DRIVER_REF), StructField("Constructor", CONSTRUCTOR_REF),
                 StructField("Time", _struct("millis", "time")))
QRESULT = _struct("number", "position", "Q1", "Q2", "Q3",
                  StructField("Driver", DRIVER_REF), StructField("Constructor", CONSTRUCTOR_REF))
RACE = _struct("season", "round", "url", "raceName", StructField("Circuit", CIRCUIT), "date",
               *[StructField(n, DATE) for n in ("FirstPractice", "SecondPractice", "ThirdPractice",
                                                "Qualifying", "Sprint", "SprintQualifying")],
               StructField("Results", ArrayType(RESULT)),
               StructField("SprintResults", ArrayType(RESULT)),
               StructField("QualifyingResults", ArrayType(QRESULT)))
DRIVER = _struct("driverId", "permanentNumber", "code", "url", "givenName", "familyName",
                 "dateOfBirth", "nationality")
CONSTRUCTOR = _struct("constructorId", "url", "name", "nationality")
MRDATA = _struct(
    "xmlns", "series", "url", "limit", "offset", "total",
    StructField("RaceTable", _struct("season", StructField("Races", ArrayType(RACE)))),
    StructField("DriverTable", _struct("season", StructField("Drivers", ArrayType(DRIVER)))),
    StructField("ConstructorTable", _struct("season", StructField("Constructors", ArrayType(CONSTRUCTOR)))),
    StructField("CircuitTable", _struct("season", StructField("Circuits", ArrayType(CIRCUIT)))),
)
SNAPSHOT_SCHEMA = StructType([StructField("MRData", MRDATA)])

RECORD_PATHS = {
    "races": "MRData.RaceTable.Races",
    "drivers": "MRData.DriverTable.Drivers",
    "constructors": "MRData.ConstructorTable.Constructors",
    "circuits": "MRData.CircuitTable.Circuits",
}


#: Message of the error that a bad document raises inside the scan.
SNAPSHOT_ERROR = "snapshot document without an MRData object"


def read_snapshot(spark: SparkSession, root: str, multiline: bool = False,
                  validate: bool = True) -> DataFrame:
    """Read documents under ``root`` (``season=YYYY/`` folders).

    ``multiline`` reads one pretty-printed document per file (the raw API
    dump); line-delimited documents (default) are splittable. With
    ``validate`` a document whose root is not an object, or whose MRData is not one, raises
    inside the scan: no extra pass over the documents.
    """
    df = (spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", multiline)
          .option("mode", "PERMISSIVE").option("basePath", root).json(root))
    df = df.withColumn("source_path", F.col("_metadata.file_path"))
    if validate:
        what = F.concat(F.lit(f"{SNAPSHOT_ERROR}: "), F.col("source_path"))
        df = df.withColumn("MRData", F.when(F.col("MRData").isNotNull(), F.col("MRData")).otherwise(F.raise_error(what)))
    return df


def records(snap: DataFrame, kind: str) -> DataFrame:
    """Explode the record array of ``kind`` keeping document order (``pos``)."""
    path = RECORD_PATHS[kind]
    return snap.select("season", "source_path", F.col("MRData.total").alias("total"),
                       F.col("MRData.offset").alias("offset"),
                       F.posexplode_outer(path).alias("pos", "rec")).where(F.col("rec").isNotNull())


def page_rows(snap: DataFrame, array_field: str = "Results") -> DataFrame:
    """Flatten paged result documents: races x results, one row per result.

    Keeps (page offset, race position, result position) for file order. A row carries its race less the race's arrays.
    """
    # outer: of an inner one Spark infers a filter on the array's size, and pushes the parsing of the document into it a second time
    # and, part by part, many times more. A document without races has a null one here, which has no results below.
    races = snap.select("season", "source_path", F.col("MRData.total").alias("total"),
                        F.col("MRData.offset").alias("offset"),
                        F.posexplode_outer(F.col("MRData.RaceTable.Races")).alias("race_pos", "race"))
    head = F.struct(*[F.col(f"race.{f.name}").alias(f.name) for f in RACE.fields if not isinstance(f.dataType, ArrayType)])
    return races.select("season", "source_path", "total", "offset", "race_pos", head.alias("race"),
                        F.posexplode(F.col(f"race.{array_field}")).alias("res_pos", "res"))


def page_audit(snap: DataFrame, array_field: str = "Results") -> DataFrame:
    """S2 completeness per season: result rows found vs the ``total`` the API announced.

    ``total`` missing or not an integer is an error (reported, not guessed);
    ``total = 0`` with no rows is a complete, empty season.
    """
    docs = snap.groupBy("season").agg(
        F.count(F.lit(1)).alias("pages"),
        F.max(F.trim(F.col("MRData.total")).try_cast("bigint")).alias("total"),
        F.sum(F.when(F.trim(F.col("MRData.total")).try_cast("bigint").isNull(), 1).otherwise(0))
         .alias("bad_total_pages"))
    rows = page_rows(snap, array_field).groupBy("season").agg(F.count(F.lit(1)).alias("rows"))
    out = docs.join(rows, "season", "left").fillna(0, subset=["rows"])
    return out.withColumn("complete", ((F.col("bad_total_pages") == 0)
                                       & (F.col("rows") == F.col("total"))).cast("int"))


#: Why a document is not one, in the order of the checks.
DOCUMENT_FAULTS = ["bad_json", "root_not_object", "mrdata_not_object", "records_missing", "records_not_array"]


def read_strict(spark: SparkSession, root: str, kind: str = "races", multiline: bool = False, on_fault: str = "raise",
                required: bool = True) -> DataFrame:
    """S1, strict: documents under ``root``, each parsed once to a VARIANT, tested, and only then shredded.

    A document is at fault if it is no JSON, its root or MRData is no object, or what stands where the records of ``kind`` should be
    is no array. Records that are absent or null are at fault too, unless not ``required`` (a page beyond the last has none).
    ``on_fault``: 'raise' (an error inside the scan that names file and fault) or 'keep' (rows with ``fault`` and the
    document's text in ``document``, and no MRData). Elements of the array that are no objects become null, as does a
    leaf that is none. ``multiline``: one document a file; else one a line (blank lines are passed over).
    """
    if on_fault not in ("raise", "keep"):
        raise ValueError("on_fault is 'raise' or 'keep'")
    text = spark.read.option("basePath", root).text(root, wholetext=multiline) \
        .withColumn("source_path", F.col("_metadata.file_path")).where(F.trim("value") != "")
    doc = text.withColumn("__doc", F.try_parse_json("value"))
    found = F.try_variant_get(F.col("__doc"), f"$.{RECORD_PATHS[kind]}", "variant")
    absent = found.isNull() | F.is_variant_null(found)
    doc = doc.withColumn("fault", F.when(F.col("__doc").isNull(), DOCUMENT_FAULTS[0])
                         .when(F.try_variant_get(F.col("__doc"), "$", "map<string,variant>").isNull(), DOCUMENT_FAULTS[1])
                         .when(F.try_variant_get(F.col("__doc"), "$.MRData", "map<string,variant>").isNull(), DOCUMENT_FAULTS[2])
                         .when(absent, DOCUMENT_FAULTS[3] if required else F.lit(None))
                         .when(F.try_variant_get(found, "$", "array<variant>").isNull(), DOCUMENT_FAULTS[4]))
    shredded = F.try_variant_get(F.col("__doc"), "$.MRData", MRDATA.simpleString())
    if on_fault == "raise":
        what = F.concat_ws(": ", F.lit("snapshot document"), "fault", "source_path")
        return doc.withColumn("MRData", F.when(F.col("fault").isNull(), shredded).otherwise(F.raise_error(what))) \
            .drop("value", "__doc", "fault")
    return doc.withColumn("MRData", F.when(F.col("fault").isNull(), shredded)) \
        .withColumn("document", F.when(F.col("fault").isNotNull(), F.col("value"))).drop("value", "__doc")


def _page_results(array_field: str) -> F.Column:
    """The results of a page's races in document order, each with its race (less its arrays)."""
    header = [f.name for f in RACE.fields if not isinstance(f.dataType, ArrayType)]

    def with_race(race: F.Column) -> F.Column:
        head = F.struct(*[race[h].alias(h) for h in header])
        return F.transform(F.coalesce(race[array_field], F.array()), lambda x: F.struct(head.alias("race"), x.alias("res")))

    return F.flatten(F.transform(F.coalesce(F.col("MRData.RaceTable.Races"), F.array()), with_race))


def page_chain(snap: DataFrame, array_field: str = "Results") -> DataFrame:
    """The pages of each season as intervals [offset, offset + rows) of result numbers, swept in order.

    Per page: ``first`` and ``until`` (its interval), ``total`` (announced), ``gap`` (numbers no page before it reaches), ``overlap`` (numbers a
    page before it had), ``past_total`` (rows beyond the total). An offset or total that is no integer gives nulls. The
    furthest number so far comes from a two-pass running maximum, so a season may have any number of pages.
    """
    pages = snap.select("season", "source_path", F.trim(F.col("MRData.offset")).try_cast("bigint").alias("first"),
                        F.trim(F.col("MRData.total")).try_cast("bigint").alias("total"), F.size(_page_results(array_field)).alias("rows"))
    pages = pages.withColumn("until", F.col("first") + F.col("rows"))
    swept = running(pages, ["season"], [F.col("first").asc_nulls_last(), F.col("until"), F.col("source_path")], "until", "reached", "max")
    reached, none = F.coalesce("reached", F.lit(0)), F.lit(0)
    return swept.withColumns({
        "gap": F.greatest(F.col("first") - reached, none),
        "overlap": F.greatest(F.least(reached, F.col("until")) - F.col("first"), none),
        "past_total": F.greatest(F.col("until") - F.greatest("first", "total"), none),
    }).drop("reached")


def chain_audit(chain: DataFrame) -> DataFrame:
    """S2 per season: pages, total, rows, gap_rows (up to the total), overlap_rows, past_total_rows, bad_pages and complete.

    Complete: every page's numbers are integers, all announce the same total, and their intervals cover it exactly once.
    """
    out = chain.groupBy("season").agg(
        F.count(F.lit(1)).alias("pages"), F.max("total").alias("total"), F.sum("rows").alias("rows"),
        F.sum("gap").alias("__gap"), F.sum("overlap").alias("overlap_rows"), F.sum("past_total").alias("past_total_rows"),
        F.sum(F.when(F.col("first").isNull() | F.col("total").isNull(), 1).otherwise(0)).alias("bad_pages"),
        F.max("until").alias("__until"), (F.min("total") != F.max("total")).alias("__differ"))
    tail = F.greatest(F.col("total") - F.coalesce("__until", F.lit(0)), F.lit(0))
    out = out.withColumn("gap_rows", F.coalesce("__gap", F.lit(0)) + F.coalesce(tail, F.lit(0)))
    whole = (F.col("bad_pages") == 0) & ~F.coalesce("__differ", F.lit(False)) & (F.col("gap_rows") == 0) \
        & (F.col("overlap_rows") == 0) & (F.col("past_total_rows") == 0)
    return out.withColumn("complete", whole.cast("int")).select("season", "pages", "total", "rows", "gap_rows", "overlap_rows",
                                                                "past_total_rows", "bad_pages", "complete")


def combined_results(snap: DataFrame, array_field: str = "Results") -> DataFrame:
    """One row for each result number of a season: pages joined, repeated numbers once, rows past the total left out.

    A race that straddles pages is whole again, as its rows are told apart by number alone. Of copies of a number the one of the
    earliest page (by offset, then path) stays. Rows of pages without an integer offset or total cannot be placed and are left out.
    """
    rows = snap.select("season", "source_path", F.trim(F.col("MRData.offset")).try_cast("bigint").alias("offset"),
                       F.trim(F.col("MRData.total")).try_cast("bigint").alias("total"), F.posexplode_outer(_page_results(array_field)).alias("pos", "r")) \
        .withColumn("number", F.col("offset") + F.col("pos")).where("number < total")  # outer as in page_rows; an empty page has no number
    copy = F.struct("offset", "source_path", "pos", "r")
    return rows.groupBy("season", "number").agg(F.min_by(copy, F.struct("offset", "source_path", "pos")).alias("c")) \
        .select("season", "number", "c.source_path", "c.offset", "c.r.race", "c.r.res")
