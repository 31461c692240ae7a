"""Periodic runs of words by recursive frequency splitting and a lag scan of what survives.

A *run* is a stretch of at least ``max(min_words, copies * q)`` consecutive words whose smallest period is q and which no
neighbouring word extends.

Method
------
1. Each word of a run occurs in it at least ``copies`` times. So a word that occurs fewer times within the current segment
   is in none of the segment's runs and splits it; the pieces are segments in which words may now be too rare again, until
   none is. Words carry the places of their neighbours of the same kind, so whether a word is too rare in a segment is
   a comparison of places. A large segment is searched from both ends in blocks of doubling size: a split costs as
   much as the smaller piece, n log n in all, however deep the recursion goes.
2. A surviving segment is scanned lag by lag, q from 1 to a third of it. A run is a stretch of at least ``(copies - 1) q`` places that
   equal the place q on, and so holds every multiple of a step in it: places are first compared at steps of q / 4 (many lags at
   once), then of q / 8, and word by word where these match long enough. What has a smaller period lies within a run found at
   that lag and is passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import bounded_batches, by_bytes, table, with_row
from priorwise.llm.registry import register

Run = tuple[int, int, int]  # start, length, period


def _neighbours(ids: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place and j < copies: the place of its word's j-th occurrence before it (or -1), and after it (or n)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    before, after = np.full((copies, n), -1, np.int64), np.full((copies, n), n, np.int64)
    before[0] = after[0] = np.arange(n)
    for j in range(1, copies):
        same = sorted_ids[j:] == sorted_ids[:-j] if n > j else np.zeros(0, bool)
        left, right = order[:-j][same], order[j:][same]
        before[j, right], after[j, left] = left, right
    return before, after


def _rare(before: np.ndarray, after: np.ndarray, low: int, high: int, a: int, b: int) -> np.ndarray:
    """Places in [a, b) whose word occurs fewer than ``copies`` times in the segment [low, high)."""
    copies = len(before)
    often = np.zeros(b - a, bool)
    for j in range(copies):
        often |= (before[j, a:b] >= low) & (after[copies - 1 - j, a:b] < high)
    return a + np.flatnonzero(~often)


def surviving_segments(ids: np.ndarray, least: int, copies: int = 3, block: int = 1024) -> list[tuple[int, int]]:
    """Segments of at least ``least`` places in which each word occurs ``copies`` times or more: no run lies elsewhere."""
    if len(ids) < least:
        return []
    common = np.flatnonzero(np.bincount(ids)[ids] < copies)
    cuts = np.r_[-1, common, len(ids)]
    wide = np.flatnonzero(np.diff(cuts) > least)
    open_segments = [(int(cuts[i]) + 1, int(cuts[i + 1])) for i in wide]
    if not open_segments:
        return []
    before, after = _neighbours(ids, copies)
    done = []
    while open_segments:
        low, high = open_segments.pop()
        left, right, size = low, high, block  # [low, left) and [right, high) hold no rare word
        found = np.zeros(0, np.int64)
        while left < right and not len(found):
            a = min(left + size, right)
            found = _rare(before, after, low, high, left, a)
            left = a
            if not len(found) and left < right:
                b = max(right - size, left)
                found = _rare(before, after, low, high, b, right)
                right = b
            size *= 2
        if not len(found):
            done.append((low, high))
            continue
        cuts = [low - 1, *found.tolist(), high]
        open_segments += [(x + 1, y) for x, y in zip(cuts, cuts[1:]) if y - x > least]
    return sorted(done)


def _stretches(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Maximal [a, b) of True of at least ``least``."""
    ends = np.flatnonzero(~equal)
    gaps = np.diff(ends, prepend=-1, append=len(equal)) - 1
    for i in np.flatnonzero(gaps >= least):
        b = int(ends[i]) if i < len(ends) else len(equal)
        yield b - int(gaps[i]), b


def _matching_lags(ids: np.ndarray, last: int, copies: int, at_once: int = 400_000) -> Iterator[int]:
    """Lags up to ``last`` that may have a run, rising: small ones, and those at which the places at steps of q / 4 match in a row.

    Many lags are compared at once; each costs a few places, so all of them cost n log n.
    """
    n, small = len(ids), min(last, 15)
    yield from range(1, small + 1)
    in_row = 4 * (copies - 1)
    low = small + 1
    while low <= last:
        high = min(last, low + max(1, at_once * low // (5 * n))) + 1
        lags = np.arange(low, high)
        steps = lags // 4
        each = -(-(n - lags) // steps)
        begins = np.cumsum(each) - each
        lag = np.repeat(lags, each)
        place = (np.arange(len(lag)) - np.repeat(begins, each)) * np.repeat(steps, each)
        unequal = np.cumsum(np.r_[0, ids[place] != ids[place + lag]])
        matched = unequal[in_row:] == unequal[:-in_row]  # rows that reach into the next lag are found out later
        yield from np.unique(lag[np.flatnonzero(matched)]).tolist()
        low = high


def segment_runs(ids: np.ndarray, min_words: int, copies: int = 3) -> list[Run]:
    """All runs of one segment."""
    n, runs = len(ids), []
    known: set[tuple[int, int]] = set()
    by_period: dict[int, list[tuple[int, int]]] = {}

    def is_multiple(q: int, a: int, b: int) -> bool:
        """Does [a, b) lie in a run whose period divides q?"""
        return any(not q % p and any(x <= a and b <= y for x, y in spans) for p, spans in by_period.items() if p < q)

    for q in _matching_lags(ids, n // copies, copies):
        least = max(min_words, copies * q) - q
        step = max(1, q // 8)
        if step == 1:
            found = list(_stretches(ids[:n - q] == ids[q:], least))
        else:
            found = []
            for a, b in _stretches(ids[:n - q:step] == ids[q::step], least // step):
                if is_multiple(q, a * step, (b - 1) * step + 1 + q):
                    continue  # all of it has the smaller period, and no more than that run can be added to it
                low, high = max((a - 1) * step + 1, 0), min(b * step, n - q)
                found += [(low + x, low + y) for x, y in _stretches(ids[low:high] == ids[low + q:high + q], least)]
        for a, b in found:
            if (a, b + q) not in known:
                known.add((a, b + q))
                by_period.setdefault(q, []).append((a, b + q))
                runs.append((a, b + q - a, q))
        if (0, n) in known:
            break  # a run of a longer period would share so many words with this one that it had its period
    return runs


def periodic_runs(words: list, min_words: int = 24, copies: int = 3) -> list[Run]:
    """All runs (start, length, period) of a sequence of words, by start and period."""
    if len(words) < min_words:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return sorted((low + s, size, q) for low, high in surviving_segments(ids, min_words, copies)
                  for s, size, q in segment_runs(ids[low:high], min_words, copies))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def greatest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; of equals the one that starts first, then the one of smallest period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def replanted(words: list, key: int | None) -> list:
    """The contract's planted repeats: for a tenth of the ids the words from some place on repeat with some period."""
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def detect_periodic(docs: DataFrame, text_col: str = "text", key_col: str | None = None, min_words: int = 24,
                    copies: int = 3) -> DataFrame:
    """The input rows as ``row`` with n_words, runs (array of start, length, period), best (such a struct) and collapsed_text.

    Words are runs without ``[\\x20\\x09-\\x0D]``, in their UTF-8 bytes. With ``key_col`` (integers) the words are first repeated as
    ``replanted`` says.

    Defined results: null, empty and blank texts have no words, no runs, a null best and an empty collapsed_text; a
    null key plants nothing; rows that repeat each get the same result; texts of any length are read whole, in one
    task's memory; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    schema = "n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed_text string"

    def of(text: str | None, key: int | None) -> tuple:
        words = replanted((text or "").encode().split(), key)
        runs = periodic_runs(words, min_words, copies)
        return len(words), runs, greatest(runs), b" ".join(collapsed(words, runs)).decode()

    @F.pandas_udf(schema)
    def detect(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            at = 0
            for part in by_bytes(iter([texts])):
                rows = [of(t, int(k) if k else None) for t, k in zip(part, keys.iloc[at:at + len(part)])]
                at += len(part)
                yield pd.DataFrame(rows, columns=["n_words", "runs", "best", "collapsed_text"])

    # keys travel as text: as numbers, large ones beside nulls would lose digits
    key = F.col(f"`{key_col}`").cast("string") if key_col else F.lit(None).cast("string")
    return with_row(docs, d=detect(F.col(f"`{text_col}`"), key)).select("row", "d.*")


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, greatest and digest of every document's periodic runs, and digest of what is left of its words."""
    out = detect_periodic(table(spark, sf_dir, "documents").select("doc_id", "text"), key_col="doc_id")
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    return out.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                      F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))
