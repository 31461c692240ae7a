"""Language identification of mixed-language text.

Method
------
* A word is a run of letters. Its *script* (by the code point range of its first letter) narrows the
  candidates to the languages that were seen in this script; the others pay a fixed cost.
* A *per-word score* for each candidate is the log-likelihood of the word's byte trigrams (boundaries
  included) and of the whole word, both hashed to a table of fixed size, with additive smoothing.
  A word's advantage is limited to ``clip`` nats, so that no rare word decides a text.
* *Viterbi* with a switching penalty labels the words; runs of one label are the spans. When no stretch of
  words gains another language more than half the penalty over the best constant path, that
  path is the best one and the recursion is skipped: the usual case of a one-language text.
* The text's language is the one with most letters; the score is its share of the letters times its
  posterior over the whole text.

Counts are gathered over all labelled rows, a table a task, and added up; the table of
``languages * 2 ** (bits + 1)`` numbers is the only thing broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import bounded_batches, by_bytes, give_back, table, with_row
from priorwise.llm.registry import register
from priorwise.llm.shingles import chunks, mix, word_hashes

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_WORD = re.compile(r"[^\W\d_]+")

# fixed values: first code point of each script range (Unicode blocks), 0 is Latin
_SCRIPTS = [(0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 6), (0x0900, 7),
            (0x0980, 8), (0x0E00, 9), (0x0E80, 10), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x1E00, 0), (0x1F00, 1),
            (0x2000, 0), (0x2E80, 14), (0x3040, 15), (0x3100, 14), (0x3130, 12), (0x3190, 14), (0xAC00, 12), (0xD7B0, 14),
            (0xF900, 14), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5), (0xFE70, 5), (0xFF00, 0), (0xFF66, 15), (0x10000, 14)]
_STARTS = np.array([s for s, _ in _SCRIPTS])
_SCRIPT_OF = np.array([n for _, n in _SCRIPTS])
N_SCRIPTS = int(_SCRIPT_OF.max()) + 1


def clean(text: str | None) -> bytes:
    """The words of a text, lower-cased, with one space between; empty if it has no letter."""
    words = _NOT_LETTERS.sub(" ", text).strip() if text else ""
    if words and not words.isascii() and not any(map(str.isalpha, words)):
        return b""  # only numerals of other scripts
    return words.lower().encode()


class Words:
    """Numbers of all words of some cleaned texts: trigram cells, word cells, scripts, letters."""

    def __init__(self, texts: list[bytes], bits: int):
        hashes, self.at = word_hashes(texts)
        buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        inside = buf != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        mask = np.uint64((1 << bits) - 1)
        here = np.flatnonzero(inside)
        wide = buf.astype(np.uint64)
        grams = wide[here - 1] << np.uint64(16) | wide[here] << np.uint64(8) | wide[here + 1]
        self.cells = (mix(grams + np.uint64(1)) & mask).astype(np.int64)  # one trigram a byte
        self.words = ((hashes & mask) + np.uint64(1 << bits)).astype(np.int64)
        self.begin = np.r_[0, np.cumsum(ends - starts)[:-1]].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        self.letters = np.add.reduceat(((buf[here] & 0xC0) != 0x80).astype(np.int64), self.begin) if len(starts) else self.begin
        # code point of the first letter
        b = [buf[np.minimum(starts + i, len(buf) - 1)].astype(np.int64) for i in range(4)]
        code = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
                         [b[0], (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63],
                         (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)
        self.scripts = _SCRIPT_OF[np.searchsorted(_STARTS, code, side="right") - 1] if len(starts) else self.begin


def _count(bits: int):
    """Task: for each language the counts of trigram cells, word cells and scripts."""
    size = (2 << bits) + N_SCRIPTS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, texts in f.groupby("lang")["text"]:
                total = counts.setdefault(lang, np.zeros(size, np.int64))
                for start in range(0, len(texts), 500):
                    for _, some in chunks([clean(t) for t in texts.iloc[start:start + 500]]):
                        w = Words(some, bits)
                        total += np.bincount(np.r_[w.cells, w.words, w.scripts + (2 << bits)].astype(np.int64), minlength=size)
        give_back()
        if counts:
            yield pd.DataFrame({"lang": list(counts), "counts": [zlib.compress(c.tobytes(), 1) for c in counts.values()]})

    return run


def _add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for f in frames:
        for lang, packed in zip(f["lang"], f["counts"]):
            add = np.frombuffer(zlib.decompress(packed), np.int64)
            sums[lang] = sums[lang] + add if lang in sums else add
    if sums:
        yield pd.DataFrame({"lang": list(sums), "counts": [zlib.compress(s.tobytes(), 1) for s in sums.values()]})


class LanguageModel:
    """Word scores of each learned language, from its counts."""

    def __init__(self, counts: dict[str, np.ndarray], bits: int = 16, penalty: float = 12.0, clip: float = 4.0,
                 smoothing: float = 0.5, rare_script: float = 0.001):
        self.langs, self.bits, self.penalty, self.clip = sorted(counts), bits, penalty, clip
        size = 1 << bits
        both = np.array([counts[l] for l in self.langs], float).reshape(len(self.langs), 2 * size + N_SCRIPTS)
        logs = []
        for part in (both[:, :size], both[:, size:2 * size]):
            p = part + smoothing
            logs.append(np.log(p / p.sum(1, keepdims=True)))
        # a row for each cell: the score of each language against the mean of all
        self.table = np.concatenate(logs, 1).T.astype(np.float32)
        if self.langs:
            self.table -= self.table.mean(1, keepdims=True)
        scripts = both[:, 2 * size:]
        seen = scripts > rare_script * scripts.sum(1, keepdims=True)
        # cost of a language for a word of a script that it isn't written in, if some language is
        self.out_of_script = (-2 * clip * (seen.any(0) & ~seen)).T.astype(np.float32)

    def scores(self, w: Words) -> np.ndarray:
        """A row for each word: scores of the languages, the best 0, the others not under -clip (or script cost)."""
        s = np.add.reduceat(self.table[w.cells], w.begin) / 2 + self.table[w.words] / 2
        s += self.out_of_script[w.scripts]
        s -= s.max(1, keepdims=True)
        return np.maximum(s, -self.clip + self.out_of_script[w.scripts])

    def path(self, s: np.ndarray) -> np.ndarray:
        """Best label of each word: scores minus the penalty of each switch."""
        total = s.sum(0)
        best = int(total.argmax())
        gain = np.cumsum(s - s[:, best:best + 1], 0)
        low = np.minimum.accumulate(np.r_[np.zeros((1, s.shape[1])), gain[:-1]])
        if (gain - low).max() <= self.penalty / 2:
            return np.full(len(s), best)
        n, width = s.shape
        value, back = s[0].tolist(), np.zeros((n, width), np.int32)
        for t, row in enumerate(s.tolist()[1:], 1):
            top = max(range(width), key=value.__getitem__)
            switch = value[top] - self.penalty
            step = back[t]
            for l in range(width):
                if value[l] >= switch:
                    step[l], row[l] = l, row[l] + value[l]
                else:
                    step[l], row[l] = top, row[l] + switch
            value = row
        out = np.empty(n, np.int64)
        out[-1] = max(range(width), key=value.__getitem__)
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """For each text: language, score and spans (language, start, end) in characters."""
        out, cleaned = [], [clean(t) for t in texts]
        for first, part in chunks(cleaned):
            w = Words(part, self.bits)
            s = self.scores(w) if self.langs and len(w.words) else np.zeros((len(w.words), len(self.langs)), np.float32)
            for i, (a, b) in enumerate(zip(w.at[:-1], w.at[1:])):
                out.append(self._one(texts[first + i], s[a:b].astype(float), w.letters[a:b]))
        return out

    def _one(self, text: str | None, s: np.ndarray, letters: np.ndarray):
        if not len(s) or not self.langs:
            return "und", 0.0, []
        labels = self.path(s)
        weight = np.bincount(labels, letters, len(self.langs))
        best = int(weight.argmax())
        # posterior of the best over the words it could have, against each other language
        against = s.sum(0) - s[:, best].sum()
        posterior = 1 / np.exp(np.clip(against, -700, 60)).sum()
        score = float(weight[best] / weight.sum() * min(posterior, 1.0))
        cuts = np.flatnonzero(np.diff(labels)) + 1
        if not len(cuts):
            return self.langs[best], score, [(self.langs[best], 0, len(text))]
        spots = [m.span() for m in _WORD.finditer(text)]
        runs = zip(np.r_[0, cuts], np.r_[cuts, len(labels)])
        return self.langs[best], score, [(self.langs[labels[a]], spots[a][0], spots[b - 1][1]) for a, b in runs]


def train_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 16,
                         max_langs: int = 500, **settings) -> LanguageModel:
    """Model of the languages in ``lang_col``, learned from all rows that have a text and a language."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")) \
        .where("text IS NOT NULL AND lang IS NOT NULL")
    parts = rows.mapInPandas(_count(bits), "lang string, counts binary").repartition("lang") \
        .mapInPandas(_add, "lang string, counts binary").limit(max_langs + 1).collect()
    if len(parts) > max_langs:
        raise ValueError(f"over {max_langs} languages: their table is too large to broadcast")
    return LanguageModel({r["lang"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in parts}, bits, **settings)


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input rows as ``row`` with lang_pred, score (0 to 1) and spans.

    Defined results: null and empty texts and texts without a letter are ``und`` with score 0 and no spans,
    and so is every text if no language was learned; ties go to the language first in order; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang string, score double, spans array<struct<lang: string, start: long, end: long>>")
    def identify_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in by_bytes(batches):
            found = shared.value.identify(list(texts))
            yield pd.DataFrame({"lang": [f[0] for f in found], "score": [f[1] for f in found],
                                "spans": [[{"lang": l, "start": int(a), "end": int(b)} for l, a, b in f[2]] for f in found]})

    # a filter on lang_pred would otherwise be pushed below with a second evaluation, in a second worker beside the first
    identify = identify_texts.asNondeterministic()
    return with_row(docs, l=identify(F.col(f"`{text_col}`"))) \
        .select("row", F.col("l.lang").alias("lang_pred"), "l.score", "l.spans")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def op7_model(docs: DataFrame) -> LanguageModel:
    return train_language_model(docs.where(fold(F.col("doc_id"), 4) != 2))


@register("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. A null doc_id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify_languages(docs.select("doc_id", "text"), op7_model(docs))
    return out.select("row.doc_id", F.coalesce(fold(F.col("row.doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
