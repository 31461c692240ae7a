"""URL filters by a cascade of Bloom filters: exact membership over the corpus's keys, without joins.

Method
------
A url's *keys* are all rules that could fit it: each suffix of its host (whole labels) with each prefix of
its path whose length some rule has, written ``host/path``. The listed rules are the set to encode, and
the distinct keys of all urls are the *universe*.

* Level 1 is a Bloom filter of the listed keys. Some other keys of the universe hit it by chance.
* Level 2 encodes these false positives; level 3 the listed keys that hit level 2; and so on, until
  a level has no false positive. A key is listed if the first level that lacks it is even, or if the last
  level it reaches is odd: exact for every key of the universe.

The universe is scanned once for each level and only false positives are ever gathered: keys that
level 1 lets through. Its bits are sized from the *counted* universe, so that about as many
false positives as listed keys are expected; each level after it halves them. The filters are broadcast,
their size is that of the list, checked against ``max_bits``; no url is ever joined or shuffled for its verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import ascii_lower, stage, table, with_row
from priorwise.llm.registry import register


class Bloom:
    """Bit array over 64-bit key hashes; ``salt`` makes the levels independent."""

    def __init__(self, hashes: np.ndarray, salt: int, rate: float):
        n = max(len(hashes), 1)
        self.salt, self.probes = salt, max(1, round(-math.log2(rate)))
        self.bits = np.zeros(max(64, math.ceil(n * self.probes / math.log(2))), bool)
        for spot in self._spots(hashes):
            self.bits[spot] = True

    def _spots(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            h = (hashes.astype(np.uint64) ^ np.uint64(self.salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
            for i in range(self.probes):
                yield ((a + np.uint64(i) * b) % np.uint64(len(self.bits))).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for spot in self._spots(hashes):
            out &= self.bits[spot]
        return out


class Cascade:
    """Levels 1, 2, ...: odd ones encode listed keys, even ones the others that got through."""

    def __init__(self, listed: np.ndarray, passed: np.ndarray, first: Bloom):
        """``passed``: hashes of the universe's keys that are not listed and hit ``first``."""
        self.levels, inside, outside = [first], listed, passed
        while len(outside):
            level = Bloom(outside, len(self.levels) + 1, 0.5)
            self.levels.append(level)
            inside, outside = outside, inside[level.has(inside)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        verdict = np.full(len(hashes), len(self.levels) % 2 == 1)
        live = np.ones(len(hashes), bool)
        for i, level in enumerate(self.levels):
            out = live & ~level.has(hashes)
            verdict[out] = i % 2 == 1  # the first level that lacks a key: level 2, 4, ... for listed ones
            live &= ~out
        return verdict


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return ascii_lower(host), path


def url_keys(host: Column, path: Column, lengths: list[int], depths: list[int]) -> Column:
    """The keys of a url that some rule may be: suffixes of as many labels as a rule's host has (``depths``), longest host first, then
    longest path. A host of any number of labels costs no more than that."""
    labels = F.split(host, r"\.", -1)
    fit = F.filter(F.array(*[F.lit(n) for n in sorted(depths, reverse=True)]), lambda n: n <= F.size(labels))
    suffixes = F.transform(fit, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]), lambda n: n <= F.char_length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda n: F.concat(s, F.substr(path, F.lit(1), n)))))


def filter_urls(pages: DataFrame, allow: list[str], block: list[str], url_col: str = "url", default: str = "allow",
                max_bits: int = 1 << 27) -> DataFrame:
    """The input rows as ``row`` with host, path, rule and verdict.

    A rule is ``host/path``: it fits the host and its subdomains if the url's path starts with the rule's.
    The longest rule that fits wins; a rule in both lists blocks. Where none fits, the key of
    the url is in neither cascade and the verdict is ``default``.

    Defined results: a null url and one without ``://`` have an empty host and path, no rule, and the
    default; an empty path fits only rules without one; empty lists and tables are fine.
    """
    spark = pages.sparkSession
    rules = {r: "allow" for r in allow} | {r: "block" for r in block}
    for r in rules:
        if "/" not in r or r.split("/")[0] != r.split("/")[0].lower():
            raise ValueError(f"rule {r!r} is not a lower-case host, / and a path")
    lengths = sorted({len(r) - r.index("/") for r in rules})
    depths = sorted({r.split("/")[0].count(".") + 1 for r in rules})
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = with_row(pages, host=host, path=path)
    keyed = rows.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths, depths)) if rules else \
        rows.withColumn("keys", F.expr("array()").cast("array<string>"))

    # the universe: all distinct keys of the corpus
    universe = stage(keyed.select(F.explode("keys").alias("key")).distinct().select("key", F.xxhash64("key").alias("h")),
                     "url-universe") if rules else None
    cascades = {v: _cascade(spark, universe, [r for r in rules if rules[r] == v], max_bits) for v in ("allow", "block")} \
        if rules else {}
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<int>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """For each key: 0 in no list, 1 in allow, 2 in block."""
        for hashes in batches:
            flat = np.concatenate([np.asarray(h, np.int64) for h in hashes] or [np.zeros(0, np.int64)]).view(np.uint64)
            kind = np.zeros(len(flat), np.int32)
            for verdict, code in (("allow", 1), ("block", 2)):
                if verdict in shared.value:
                    kind[shared.value[verdict].has(flat)] = code
            ends = np.cumsum([len(h) for h in hashes])
            yield pd.Series(np.split(kind, ends[:-1])) if len(hashes) else pd.Series([], dtype=object)

    kinds = keyed.withColumn("kinds", listed(F.transform("keys", lambda k: F.xxhash64(k))))
    fits = F.filter(F.arrays_zip("keys", "kinds"), lambda z: z["kinds"] > 0)
    longest = F.array_max(F.transform(fits, lambda z: F.struct(F.char_length(z["keys"]).alias("n"), z["kinds"].alias("kind"),
                                                               z["keys"].alias("key"))))
    judged = kinds.withColumn("best", longest)
    return judged.select("row", "host", "path", F.col("best.key").alias("rule"),
                         F.when(F.col("best.kind") == 2, "block").when(F.col("best.kind") == 1, "allow")
                         .otherwise(default).alias("verdict"))


def _cascade(spark: SparkSession, universe: DataFrame, listed: list[str], max_bits: int) -> Cascade:
    """Cascade of the listed keys, exact over the universe."""
    keys = spark.createDataFrame([(r,) for r in listed], "key string").select(F.xxhash64("key").alias("h"))
    inside = np.array([r["h"] for r in keys.collect()], np.int64).view(np.uint64)
    size = universe.count()
    first = Bloom(inside, 1, min(0.5, max(len(inside), 1) / max(size, 1)))
    if len(first.bits) > max_bits:
        raise ValueError(f"the list needs {len(first.bits)} bits; max_bits is {max_bits}")
    shared = spark.sparkContext.broadcast((first, set(inside.tolist())))

    def through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bloom, own = shared.value
        for f in frames:
            h = f["h"].to_numpy(np.int64).view(np.uint64)
            hit = h[bloom.has(h)]
            yield pd.DataFrame({"h": np.array([x for x in hit.tolist() if x not in own], np.uint64).view(np.int64)})

    passed = [r["h"] for r in universe.select("h").mapInPandas(through, "h long").toLocalIterator()]
    return Cascade(inside, np.array(passed, np.int64).view(np.uint64), first)


ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]

SQL = """
WITH p AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p
), u AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
         ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
         ('com/de/', 'com', '/de/', 'block')
), m AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS nth
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.nth = 1
"""


@register("op10_url_filter", SQL)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), ALLOW, BLOCK)
    return out.select("row.page_id", "host", "path", "rule", "verdict")
