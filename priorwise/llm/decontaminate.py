"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Method
------
A text is normalised to words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Every
window of ``window`` consecutive words of an item (the whole item when it has fewer) is a pattern; its
symbols are word numbers, so the automaton steps once a word and every text is scanned once.
Words that no item has are symbol 0, which no pattern holds. Hits are word ranges, mapped back
to character offsets of the original text.

The items are read shard by shard, each of at most ``max_shard_bytes`` of text, and only that much
is ever held by the driver, broadcast, or built into an automaton at once. A benchmark within one shard
(any usual one) has one automaton a worker; a larger one is scanned shard after shard, with the same results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import bounded_batches, by_bytes, table, with_row
from priorwise.llm.registry import register

# one step from raw bytes to words: A-Z to a-z, other word bytes as they are, the rest to spaces
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # on text that is not lower-cased

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Matcher:
    """Automaton of one shard of items: (item id as string or None, text) pairs."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str | None]] = {}
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(len(ids) - window + 1, 1) if ids else 0):
                patterns.setdefault(tuple(ids[i:i + window]), set()).add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, owners in patterns.items():
            self.automaton.add_word(p, (len(p), owners))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, words: list[bytes], marks: bytearray, found: set[str]) -> None:
        """Mark every word inside an occurrence and collect the ids of the items."""
        if self.empty or not words:
            return
        get = self.vocab.get
        for end, (n, owners) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            marks[end - n + 1:end + 1] = b"\x01" * n
            found |= owners


def spans_of(text: str, marks: bytearray) -> list[tuple[int, int]]:
    """Runs of marked words as [start, end) character offsets of ``text``."""
    out, last = [], False
    for m, word in zip(marks, _WORD.finditer(text), strict=True):
        if m and last:
            out[-1] = (out[-1][0], word.end())
        elif m:
            out.append(word.span())
        last = bool(m)
    return out


def _shards(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> list:
    sc, out, part, size = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    for item_id, text in rows.toLocalIterator():
        n = len((text or "").encode())
        if part and size + n > max_bytes:
            out.append(sc.broadcast(part))
            part, size = [], 0
        part.append((item_id, text))
        size += n
    return out + [sc.broadcast(part)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = 10, max_shard_bytes: int = 16_000_000) -> DataFrame:
    """The input rows as ``row`` with n_words, n_hit, items (sorted ids) and spans of hit text.

    Defined results: null and empty texts have no words, hits or items; an item without words matches
    nothing; an item whose id is null marks words but is not listed; items that share a text are all
    listed, an id once; an empty benchmark leaves every document clean; an empty table gives no rows.
    """
    shards = _shards(benchmark, item_id_col, item_text_col, max_shard_bytes)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        single = Matcher(shards[0].value, window) if len(shards) == 1 else None
        for texts in by_bytes(batches):
            words = [words_of(t) for t in texts]
            marks, found = [bytearray(len(w)) for w in words], [set() for _ in words]
            for shard in shards:
                matcher = single or Matcher(shard.value, window)
                for w, m, f in zip(words, marks, found):
                    matcher.scan(w, m, f)
            yield pd.DataFrame({
                "n_words": [len(w) for w in words], "n_hit": [sum(m) for m in marks],
                "items": [sorted(f - {None}) for f in found],
                "spans": [[{"start": a, "end": b} for a, b in spans_of(t, m)] if any(m) else []
                          for t, m in zip(texts, marks)]})

    rows = with_row(docs, hit=scan(F.col(f"`{text_col}`")))
    return rows.select("row", "hit.n_words", "hit.n_hit", "hit.items", "hit.spans")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), ip AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
  FROM iw WHERE len(w) > 0
), p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM ip
), sizes AS (
  SELECT DISTINCT n FROM p
), dp AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n
), hits AS (
  SELECT dp.doc_id, dp.i, dp.n, p.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM dp) dp
  JOIN p ON dp.n = p.n AND dp.win = p.win
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""


@register("op5_decontaminate", SQL)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    hits = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))
