"""Scalar column expressions (X1-X7, X9, X10). All JVM-side, no Python UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_int(x: Column | str) -> Column:
    """Trimmed text -> bigint; empty, '1.5' or junk -> NULL."""
    s = F.trim(_c(x).cast("string"))
    return F.when(s != "", s.try_cast("bigint"))


def safe_float(x: Column | str) -> Column:
    """Trimmed text -> double; empty or junk -> NULL (never NaN)."""
    s = F.trim(_c(x).cast("string"))
    d = F.when(s != "", s.try_cast("double"))
    return F.when(~F.isnan(d), d)


def normalize_status(x: Column | str) -> Column:
    """Trim, lower-case, collapse runs of whitespace to one space."""
    return F.regexp_replace(F.lower(F.trim(_c(x))), r"\s+", " ")


# Status taxonomy keywords (plain substring matching, in rule order).
INCIDENT_WORDS = ["accident", "collision", "crash", "spun", "spun off", "spin", "damage"]
MECHANICAL_WORDS_RACE = [
    "engine", "gearbox", "hydraulics", "electrical", "electronics", "brakes", "brake", "suspension",
    "transmission", "clutch", "fuel", "oil", "water", "radiator", "pneumatics", "turbo", "power unit",
    "powerunit", "power loss", "puncture", "driveshaft", "steering", "battery", "mgu", "ers", "retired",
    "mechanical", "wheel", "tyre", "undertray", "rear wing", "front wing", "cooling system",
    "differential", "vibrations",
]
MECHANICAL_WORDS_SPRINT = [
    "engine", "gearbox", "hydraulics", "electrical", "brakes", "brake", "suspension", "transmission",
    "clutch", "fuel", "oil", "water", "radiator", "pneumatics", "turbo", "power unit", "powerunit",
    "puncture", "driveshaft", "steering", "battery", "mgu", "ers",
]
CATEGORIES = ["CLASSIFIED", "DSQ", "DNS", "INCIDENT", "MECHANICAL", "OTHER"]


def _any_contains(s: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(w) for w in words])


def status_category(x: Column | str, sprint: bool = False) -> Column:
    """Ordered first-match status rules on the normalised text.

    CLASSIFIED: 'finished', starts with '+', or 'lapped' (race rules only);
    DSQ: contains 'disqualified'; DNS: 'did not start' or 'withdrew';
    then incident words, then mechanical words, else OTHER.
    """
    return category_of(normalize_status(x), sprint)


def category_of(x: Column | str, sprint: bool = False) -> Column:
    """X4 of a status that is normalised already; it is named some 50 times here, so a column of its own costs less."""
    s = _c(x)
    classified = (s == "finished") | s.startswith("+")
    if not sprint:
        classified = classified | (s == "lapped")
    mech = MECHANICAL_WORDS_SPRINT if sprint else MECHANICAL_WORDS_RACE
    return (F.when(classified, "CLASSIFIED")
            .when(s.contains("disqualified"), "DSQ")
            .when(s.contains("did not start") | s.contains("withdrew"), "DNS")
            .when(_any_contains(s, INCIDENT_WORDS), "INCIDENT")
            .when(_any_contains(s, mech), "MECHANICAL")
            .otherwise("OTHER"))


def status_category_sql(col: str, sprint: bool = False) -> str:
    """The same rules as a SQL CASE (for oracle queries)."""
    s = f"regexp_replace(lower(trim({col})), '\\s+', ' ', 'g')"
    mech = MECHANICAL_WORDS_SPRINT if sprint else MECHANICAL_WORDS_RACE
    cls = f"{s} = 'finished' OR starts_with({s}, '+')" + ("" if sprint else f" OR {s} = 'lapped'")

    def anyc(ws):
        return " OR ".join(f"contains({s}, '{w}')" for w in ws)

    return (f"CASE WHEN {cls} THEN 'CLASSIFIED' "
            f"WHEN contains({s}, 'disqualified') THEN 'DSQ' "
            f"WHEN contains({s}, 'did not start') OR contains({s}, 'withdrew') THEN 'DNS' "
            f"WHEN {anyc(INCIDENT_WORDS)} THEN 'INCIDENT' "
            f"WHEN {anyc(mech)} THEN 'MECHANICAL' ELSE 'OTHER' END")


LAPTIME_RE = r"^(?:(\d+):)?(\d+)\.(\d*)$"


def laptime_ms(x: Column | str) -> Column:
    """X3: 'm:ss.fff' or 'ss.fff' -> milliseconds; fraction right-padded /
    truncated to 3 digits; no dot, empty or junk -> NULL."""
    s = F.trim(_c(x))
    ok = s.rlike(LAPTIME_RE)
    mins = F.coalesce(F.nullif(F.regexp_extract(s, LAPTIME_RE, 1), F.lit("")).cast("bigint"), F.lit(0))
    secs = F.regexp_extract(s, LAPTIME_RE, 2).cast("bigint")
    frac = F.substring(F.rpad(F.regexp_extract(s, LAPTIME_RE, 3), 3, "0"), 1, 3).cast("bigint")
    return F.when(ok, mins * 60000 + secs * 1000 + frac)


def normalize_id(x: Column | str, upper: bool = False) -> Column:
    """Trimmed, lower- (or upper-) cased id; empty -> NULL."""
    s = F.trim(_c(x).cast("string"))
    s = F.upper(s) if upper else F.lower(s)
    return F.when(s != "", s)


def seconds_to_ms(x: Column | str) -> Column:
    """Duration in seconds (double) -> milliseconds (double)."""
    return _c(x).cast("double") * 1000.0


def path_key(path: Column | str, key: str = "round") -> Column:
    """Integer value of a ``key=NN`` path segment, NULL when absent."""
    v = F.regexp_extract(_c(path), key + r"=(\d+)", 1)
    return F.when(v != "", v.cast("bigint"))
