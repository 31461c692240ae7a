"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Method
------
* A text's tokens are its runs of letters, of digits and of punctuation (white space parts, letters
  are lower-cased A-Z; a run of capitals of two letters or more adds a marker). Its features are the hashed unigrams and bigrams of
  these tokens with weight ``1 + log(count)``, scaled to length 1, and a bias.
* Training is FTRL-proximal with one learning rate a coordinate and L1 and L2 terms. ``shards``
  learners run side by side on a hash-dealt part of the sample, ``epochs`` times each; their weights are averaged.
* A score is the logistic of the sparse dot product of features and weights; whole texts, one pass.

The sample: at most ``max_rows`` labelled rows, those with the smallest hash of the id; ids are joined to the
texts as a broadcast of that many ids, and the weights broadcast are ``2 ** bits`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import bounded_batches, by_bytes, table, with_row
from priorwise.llm.registry import register
from priorwise.llm.shingles import chunks, mix, token_hashes

_CLASS = np.full(256, 3, np.uint8)  # 0 white space, 1 letters (and all non-ASCII), 2 digits, 3 the rest
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48  # one digit stands for all
_CAPS, _AGAIN = np.uint64(0x51ED270B7A14D9C5), np.uint64(0x2B8F1C6E93D7A04F)


def features(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the cells of its features (sorted) and their weights; cell ``2 ** bits`` is the bias."""
    mask = np.uint64((1 << bits) - 1)
    raw = [t.encode() if t else b"" for t in texts]
    for _, part in chunks(raw):
        tokens, at, kinds, caps = token_hashes(part, _CLASS, _LOWER)
        ones = (tokens & mask).astype(np.int64)
        twos = (mix(tokens[:-1] * np.uint64(3) + mix(tokens[1:])) & mask).astype(np.int64)
        again = kinds == 1  # words that stood one or two tokens before
        again[:1] = False
        again[1:] &= (tokens[1:] == tokens[:-1]) | np.append([False], tokens[2:] == tokens[:-2])[:len(tokens) - 1]
        for a, b in zip(at[:-1], at[1:]):
            marks = [np.full(int(m[a:b].sum()), cell) for m, cell in ((caps, _CAPS & mask), (again, _AGAIN & mask))]
            cells = np.concatenate([ones[a:b], twos[a:max(b - 1, a)], *marks]).astype(np.int64)
            cells, count = np.unique(cells, return_counts=True)
            x = 1 + np.log(count)
            norm = np.sqrt((x * x).sum()) or 1.0
            yield np.append(cells, 1 << bits), np.append(x / norm, 0.2)


class Ftrl:
    """FTRL-proximal state and updates of a logistic regression."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, cells=slice(None)) -> np.ndarray:
        z, n = self.z[cells], self.n[cells]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, cells: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(cells)
        g = (logistic(float(w @ x)) - label) * x
        n = self.n[cells]
        self.z[cells] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[cells] = n + g * g


def logistic(t):
    return 1 / (1 + np.exp(-np.clip(t, -35, 35)))


def _train(bits: int, epochs: int):
    """Task: the learners of its shards, over rows sorted by (shard, place)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[int, list] = {}
        for f in frames:
            for start in range(0, len(f), 500):
                some = f.iloc[start:start + 500]
                for shard, label, x in zip(some["shard"], some["label"], features(list(some["text"]), bits)):
                    rows.setdefault(shard, []).append((*x, label))
        for shard, examples in rows.items():
            learner = Ftrl((1 << bits) + 1)
            for _ in range(epochs):
                for cells, x, label in examples:
                    learner.learn(cells, x, label)
            yield pd.DataFrame({"n": [len(examples)], "w": [learner.weights().astype(np.float32).tobytes()]})

    return run


def train_quality(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", bits: int = 18, max_rows: int = 16_384, shards: int = 4,
                  epochs: int = 4) -> np.ndarray:
    """Weights learned from a bounded sample of the labelled rows; all zero if there are none.

    Rows whose label is null or neither 0 nor 1, ids with contradicting labels, and null ids are not learned from.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where("label IN (0, 1) AND id IS NOT NULL") \
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    sample = known.select("id", "label", F.xxhash64("id").alias("place")).orderBy("place", "id").limit(max_rows)
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")) \
        .join(F.broadcast(sample), "id") \
        .select("text", "label", "place", F.pmod(F.shiftright("place", 7), F.lit(shards)).alias("shard"))
    learned = rows.repartition(shards, "shard").sortWithinPartitions("shard", "place", "text") \
        .mapInPandas(_train(bits, epochs), "n long, w binary").collect()  # ``shards`` rows
    total = np.zeros((1 << bits) + 1)
    for r in learned:
        total += r["n"] * np.frombuffer(r["w"], np.float32)
    return (total / max(sum(r["n"] for r in learned), 1)).astype(np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The input rows as ``row`` with ``score`` (0 to 1).

    Defined results: null and empty texts have the bias alone; equal texts have equal scores; an empty
    table gives no rows.
    """
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in by_bytes(batches):
            yield pd.Series([float(logistic(float(w[c] @ x))) for c, x in features(list(texts), bits)])

    return with_row(docs, score=score(F.col(f"`{text_col}`")))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 3


@register("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document. A null doc_id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 1)
    out = score_quality(docs, train_quality(docs, labels))
    return out.select("row.doc_id", F.coalesce(fold(F.col("row.doc_id")) == 1, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
