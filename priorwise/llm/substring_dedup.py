"""Repeated passages: each window of words that also starts earlier goes, found through a count-min sketch.

Method
------
1. *Sketch.* A window's *anchor* is its word gram (half a window long) of least hash, the first of equals. Two places where
   a window starts have anchors at two places, so the count of an anchor's gram is at least that of each window which it
   stands for, and there are several times fewer anchors than windows. Each partition counts its anchors in two rows of cells
   (counts above 1 are all alike here) and sends the cells it has touched; these are merged range by range. What
   goes back to the tasks is one bit a cell. Counts are only ever too large, so no repeated window is lost. The cells
   are sized from the bytes of the corpus, up to ``max_bits``; past that the sketch lets more windows through, to equal results.
2. *Exact grouping.* A second pass takes the windows whose anchor's estimate is 2 or more and groups them by a 128-bit digest of
   their words: first within an Arrow batch, where all but the first place of a window is decided, then, over one row a
   batch and window, in Spark. So a passage that a third of all documents hold is one row a batch for each of its windows.
3. Places that are not a window's first become ranges of words to remove, gathered by document and joined to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorwise.llm import shingles as S
from priorwise.llm.common import bounded_batches, by_bytes, give_back, table, with_row
from priorwise.llm.registry import register

_ROWS = 2
_SEEDS = S.mix(np.arange(1, _ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PART_BITS = 20  # cells of a row that are merged together


def _words(text: str | None) -> bytes:
    """The words, parted by one space."""
    return b" ".join(text.encode().split()) if text else b""


def _windows(texts: list[bytes], size: int) -> Iterator[tuple]:
    """By chunk of texts: (bytes, word starts, word ends, gram hashes, window starts, their anchors, windows' texts, first words of texts).

    Starts, ends, windows and anchors count the words of the chunk.
    """
    gram = max(1, size // 2)
    for first, part in S.chunks(texts):
        buf, begins = S._joined(part)
        white = S._WHITE[buf]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        at = np.searchsorted(starts, begins)
        text = np.repeat(np.arange(len(part)), np.diff(at))
        window = np.flatnonzero(np.arange(len(starts)) + size <= at[1:][text])
        if not len(window):
            continue
        grams = S._run_hashes(buf, starts[:len(starts) - gram + 1], ends[gram - 1:])
        anchor = window + sliding_window_view(grams, size - gram + 1)[window].argmin(axis=1)
        yield buf, starts, ends, grams, window, anchor, first + text[window], at


def _cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each gram in each row of the sketch."""
    return [(S.mix(grams ^ seed) >> np.uint64(64 - bits)).astype(np.int64) for seed in _SEEDS]


def _folded(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, rising, and their counts, 2 at most."""
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    begins = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[begins], np.minimum(np.add.reduceat(counts, begins), 2) if len(begins) else counts[:0]


def _count(size: int, bits: int, part_bits: int, at_once: int = 4_000_000):
    """Task: the cells it has touched, as (part, cells within it times two, plus one where it counted 2 or more)."""

    def messages(cells: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts, begins = np.unique(cells >> part_bits, return_index=True)
        packed = (((cells & ((1 << part_bits) - 1)) << 1) | (counts > 1)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([p.tobytes() for p in np.split(packed, begins[1:])] if len(begins) else [],
                                                                                     pa.binary())], ["part", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = 0
        for b in batches:
            for _, _, _, grams, _, anchor, _, _ in _windows([_words(t) for t in b.column(0).to_pylist()], size):
                found = grams[np.unique(anchor)]
                for r, c in enumerate(_cells(found, bits)):
                    cells.append(c + (r << bits))
                    counts.append(np.ones(len(c), np.int64))
                    held += len(c)
                if held > at_once:
                    some = _folded(np.concatenate(cells), np.concatenate(counts))
                    if len(some[0]) > at_once // 2:
                        yield from messages(*some)
                        some = some[0][:0], some[1][:0]
                    cells, counts, held = [some[0]], [some[1]], len(some[0])
        yield from messages(*_folded(np.concatenate(cells), np.concatenate(counts)))
        give_back()

    return run


def _merge(part_bits: int):
    """Task: bits of the cells that count 2 or more over all messages; rows come sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, np.zeros(0, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["part", "bits"])

        for b in batches:
            for here, packed in zip(b.column(0).to_pylist(), b.column(1)):
                if here != part:
                    if part is not None:
                        yield done()
                    part, counts = here, np.zeros(1 << part_bits, np.uint8)
                cells = np.frombuffer(packed.as_buffer(), np.uint32)
                at = cells >> 1
                counts[at] = np.minimum(counts[at] + 1 + (cells & 1), 2)
        if part is not None:
            yield done()

    return run


def repeated_bits(texts: DataFrame, size: int, bits: int) -> np.ndarray:
    """The merged sketch: packed bits, row after row, of the cells that count 2 or more. ``texts``: one column."""
    part_bits = min(_PART_BITS, bits)
    parts = _ROWS << (bits - part_bits)
    n = min(parts, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = texts.mapInArrow(_count(size, bits, part_bits), "part int, cells binary").repartition(n, "part").sortWithinPartitions("part") \
        .mapInArrow(_merge(part_bits), "part int, bits binary")
    out = np.zeros((_ROWS << bits) // 8, np.uint8)
    width = (1 << part_bits) // 8
    for r in merged.toLocalIterator(prefetchPartitions=True):  # 2 ** (max_bits + 1) bits at most
        out[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def _candidates(size: int, bits: int, sketch):
    """Task: of each batch the first place of each window that may repeat (high null), and the ranges to remove that it decides itself.

    Rows come in the order of places: then neighbours in a shuffle block share document and mark, and compress well.
    """

    def estimate(grams: np.ndarray) -> np.ndarray:
        """Does each gram count 2 or more in both rows?"""
        twice, packed = np.ones(len(grams), bool), sketch.value
        for r, c in enumerate(_cells(grams, bits)):
            at = c + (r << bits)
            twice &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = b.column(0).to_pylist(), b.column(1).to_pylist()
            names = sorted({((i is None), i or 0, m) for i, m in zip(ids, marks)})
            rank = {x: k for k, x in enumerate(names)}
            ranks = np.array([rank[(i is None), i or 0, m] for i, m in zip(ids, marks)], np.int64)
            digests, places = [], []
            for buf, starts, ends, grams, window, anchor, text, at in _windows([_words(t) for t in b.column(2).to_pylist()], size):
                used, back = np.unique(anchor, return_inverse=True)
                may = np.flatnonzero(estimate(grams[used])[back])
                data, which = buf.tobytes(), window[may]
                digests += [hashlib.blake2b(data[x:y], digest_size=16).digest()
                            for x, y in zip(starts[which].tolist(), ends[which + size - 1].tolist())]
                owner = text[may]
                first_word = at[np.searchsorted(at, which, side="right") - 1]
                places.append(ranks[owner] << 32 | (which - first_word))
            if not digests:
                continue
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            place = np.concatenate(places)
            order = np.lexsort((place, keys[:, 1], keys[:, 0]))
            keys, place = keys[order], place[order]
            new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
            group = np.cumsum(new) - 1
            least = place[new]
            later = np.unique(place[place != least[group]])
            begin = np.flatnonzero(np.r_[True, (np.diff(later) > size) | (np.diff(later >> 32) > 0)]) if len(later) else later
            last = later[np.r_[begin[1:] - 1, len(later) - 1]] if len(later) else later
            by_place = np.argsort(least)
            place = np.r_[least[by_place], later[begin]]
            high = np.r_[np.zeros(len(least), np.int32), ((last & 0xFFFFFFFF) + size).astype(np.int32)]
            first = keys[new][by_place]
            spread = S.mix(later[begin].astype(np.uint64)).astype(np.int64)  # ranges go anywhere
            ids, marks = (np.array([x[i] for x in names], np.int64) for i in (1, 2))
            none = np.array([x[0] for x in names])
            held = place >> 32
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[first[:, 0], spread]), pa.array(np.r_[first[:, 1], spread]),
                 pa.array(ids[held], mask=none[held]), pa.array(marks[held]),
                 pa.array((place & 0xFFFFFFFF).astype(np.int32)), pa.array(high, mask=high == 0)],
                ["k1", "k2", "doc", "mark", "low", "high"])
        give_back()

    return run


def _keep(words: list[bytes], low: np.ndarray, high: np.ndarray) -> list[bytes]:
    """The words that lie in none of the ranges [low, high)."""
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, low.astype(np.int64), 1)
    np.add.at(ends, high.astype(np.int64), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(ends)[:-1] == 0)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, max_bits: int = 29) -> DataFrame:
    """The input rows as ``row`` with n_words, n_removed and kept_text (the words that stay, joined by one space).

    Each word goes that lies in a window of ``size`` consecutive words of a document whose word sequence also starts earlier: in a
    document of a smaller id, or earlier in the same one. Words are runs without ``[\\x20\\x09-\\x0D]``, compared by their bytes.

    Defined results: null, empty and blank texts, and texts of fewer than ``size`` words, lose nothing; documents without an id come
    after all others; documents of one id (or none) come in the order of their texts' hashes, and rows that are equal in id and text are
    one document, of which each copy gets the same result; texts of any length are read whole; an empty table gives no rows. Ids are
    64-bit integers.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col(f"`{text_col}`")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(max_bits, max(16, int(total // 8).bit_length()))  # some six cells a row for each anchor
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text")).where("text <> ''")
    sketch = spark.sparkContext.broadcast(repeated_bits(base.select("text"), size, bits))
    found = base.mapInArrow(_candidates(size, bits, sketch), "k1 long, k2 long, doc long, mark long, low int, high int")
    # one shuffle: windows meet by digest, ranges (told apart by high) just pass; copies of a row have equal places and rank alike
    order = Window.partitionBy("k1", "k2", "high").orderBy(F.col("doc").asc_nulls_last(), "mark", "low")
    gone = found.withColumn("rank", F.rank().over(order)).where("high IS NOT NULL OR rank > 1")
    decided = F.when(F.col("high").isNotNull(), F.array("low", "high"))
    ranges = gone.groupBy("doc", "mark").agg(F.collect_list(F.when(F.col("high").isNull(), F.col("low"))).alias("lows"),
                                             F.flatten(F.collect_list(decided)).alias("ranges"))

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lows, spans in batches:
            at = 0
            for part in by_bytes(iter([texts])):
                rows = []
                for t, low, span in zip(part, lows.iloc[at:at + len(part)], spans.iloc[at:at + len(part)]):
                    words = t.encode().split() if t else []
                    kept = words if low is None else _keep(words, np.r_[low, span[::2]], np.r_[low + size, span[1::2]])
                    rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
                at += len(part)
                yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])

    rows = with_row(docs, doc=F.col(f"`{id_col}`").cast("long"), mark=F.xxhash64(text))
    joined = rows.alias("a").join(ranges.alias("b"), F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.mark") == F.col("b.mark")), "left")
    return joined.select("row", cut(F.col("row").getField(text_col), F.col("lows"), F.col("ranges")).alias("d")).select("row", "d.*")


@register("op12_substring_dedup")
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of what is left, of every document."""
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
