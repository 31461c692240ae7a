"""BPE encoding and decoding by prefix-sharing trie traversal.

Method
------
A byte-pair encoding is fixed by its last token and the encoding of what stands before it: a sequence of
tokens is the encoding of its text exactly if each token encodes to itself and each adjacent pair
encodes to that pair. So each prefix of a word has one *last token*: the vocabulary token that ends
there and is compatible with the last token of the prefix before it. The words of a batch that
are not cached yet are inserted into a trie; walking it depth first, each node gets its last token from
the states of its ancestors, so a prefix that many words share is computed once. A suffix automaton
of the vocabulary, stepped along, lists the tokens that end at a node. A word is read
off by jumping back from its leaf, token by token.

The final byte of a word carries the vocabulary's end-of-word suffix and is a symbol of its own, so it
never takes part in a shared prefix.

Supported vocabularies: the tokenizers library's JSON with an NFC + white space + lower-case
normaliser, one split pattern, byte-level pre-tokens and BPE merges (e.g. ``word_bpe_49k.json``). The
file is a parameter; its content (checked to be under ``max_vocab_bytes``) is broadcast.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import bounded_batches, by_bytes, table, with_row
from priorwise.llm.registry import register

# the library's normaliser and split, which the file must name
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\p{Z}\p{L}\p{N}]+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r\x20a-z0-9]+")


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where printable, else the next one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class TrieBPE:
    """Encoder and decoder of one vocabulary file's content."""

    def __init__(self, content: str, cache_words: int = 400_000, trie_words: int = 20_000):
        spec = json.loads(content)
        model = spec["model"]
        parts = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (model["type"] != "BPE" or [p["type"] for p in parts] != _NORMALIZERS or spec["decoder"] is not None
                or split["pattern"] != {"Regex": _SPLIT} or model["continuing_subword_prefix"]):
            raise ValueError("this vocabulary's normaliser, split or decoder is not supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.merges = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that strip or need whole words are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first)) or '(?!)'})")
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self.pair_ok: dict[int, bool] = {}
        # (ids, decoded text) of pieces; the pieces of the generation before are kept until this one is full
        self.known: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}
        self.cache_words, self.trie_words = cache_words, trie_words
        self._suffix_automaton()

    # -- single tokens and pairs, by the merges themselves

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merge(self, parts: list[str]) -> list[str]:
        """Apply the merges, lowest rank first, leftmost first among equals."""
        while len(parts) > 1:
            rank, at = min((self.merges.get(p, len(self.merges)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.merges):
                break
            parts = parts[:at] + [parts[at] + parts[at + 1]] + parts[at + 2:]
        return parts

    def _follows(self, left: int, right: int) -> bool:
        """Does the two tokens' text encode to just these two?"""
        if (ok := self.pair_ok.get(left << 24 | right)) is None:
            a, b = self.text_of[left], self.text_of[right]
            if len(self.pair_ok) > 300_000:
                self.pair_ok.clear()
            ok = self.pair_ok[left << 24 | right] = self._merge(self._symbols(a) + self._symbols(b)) == [a, b]
        return ok

    # -- the trie; symbols are bytes, and 256 + byte for a word's last one

    def _suffix_automaton(self) -> None:
        """For each suffix state: the vocabulary tokens that stand and end there, longest first."""
        number = {c: b for b, c in enumerate(self.alphabet)}
        number |= {c + self.end: 256 + b for b, c in enumerate(self.alphabet)} if self.end else {}
        children: list[list[int]] = [[]]
        self.goto: dict[int, int] = {}  # state * 512 + symbol
        self.ending: list[tuple[tuple[int, int], ...]] = [()]
        for text, token in self.vocab.items():
            symbols = self._symbols(text)
            if self._merge(symbols) != [text]:
                continue
            state = 0
            for s in symbols:
                edge = state << 9 | number[s]
                if edge not in self.goto:
                    self.goto[edge] = len(children)
                    children[state].append(edge)
                    children.append([])
                    self.ending.append(())
                state = self.goto[edge]
            self.ending[state] = ((token, len(symbols)),)
        self.fail, queue = [0] * len(children), [0]
        for state in queue:  # breadth first: grows while it is read
            self.ending[state] += self.ending[self.fail[state]] if state else ()
            for edge in children[state]:
                child = self.goto[edge]
                self.fail[child] = self._step(self.fail[state], edge & 511) if state else 0
                queue.append(child)

    def _step(self, state: int, symbol: int) -> int:
        """State of the longest vocabulary prefix that ends after ``symbol``."""
        goto = self.goto
        while (to := goto.get(state << 9 | symbol)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return to

    def _last(self, state: int, depth: int, lasts: list[int]) -> tuple[int, int]:
        """Last token, and its length, at a node; ``lasts[i]`` is that of its ancestor at depth i."""
        for token, size in self.ending[state]:
            if size == depth or self._follows(lasts[depth - size], token):
                return token, size
        raise ValueError("no token ends here: the vocabulary lacks a byte")

    def encode_distinct(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of distinct words."""
        edges: dict[int, int] = {}  # node * 256 + byte
        first, sibling, symbol, leaves = [0], [0], [0], {}
        for at, word in enumerate(words):
            node = 0
            for b in word[:-1]:
                child = edges.get(node << 8 | b)
                if child is None:
                    child = edges[node << 8 | b] = len(first)
                    sibling.append(first[node])
                    first[node] = child
                    first.append(0)
                    symbol.append(b)
                node = child
            leaves.setdefault(node, []).append(at)
        out: list[list[int]] = [[]] * len(words)
        ending = 256 if self.end else 0
        # states of the nodes on the current path, by depth: last token and its length
        lasts, sizes = [0], [0]
        stack = [(0, 0, 0)]
        while stack:
            node, depth, state = stack.pop()
            if depth:
                state = self._step(state, symbol[node])
                token, size = self._last(state, depth, lasts)
                lasts[depth:], sizes[depth:] = [token], [size]
            for at in leaves.get(node, ()):
                token, size = self._last(self._step(state, ending + words[at][-1]), depth + 1, lasts)
                ids, left = [token], depth + 1 - size
                while left:
                    ids.append(lasts[left])
                    left -= sizes[left]
                out[at] = ids[::-1]
            child = first[node]
            while child:
                stack.append((child, depth + 1, state))
                child = sibling[child]
        return out

    # -- texts

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if text.isascii():
            return _ASCII_PIECES.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # lower-casing is by character: a final sigma is no exception
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return _PIECES.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Fill the cache with the encodings of the pieces that it lacks, a bounded trie at a time."""
        if len(self.known) + len(pieces.difference(self.known)) > self.cache_words // 2:
            self.known, self.before = {}, self.known
        again = self.before.keys() & pieces.difference(self.known)
        self.known.update((p, self.before[p]) for p in again)
        new = sorted(pieces.difference(self.known))
        for i in range(0, len(new), self.trie_words):
            some = new[i:i + self.trie_words]
            for piece, ids in zip(some, self.encode_distinct([p.encode() for p in some])):
                self.known[piece] = array("I", ids).tobytes(), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file: the tokens' texts joined by spaces."""
        return " ".join([self.text_of[i] for i in ids])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text: ids as little-endian unsigned 32-bit integers, and what they decode to."""
        runs = []  # for each text, pieces and added tokens in turn
        for text in texts:
            runs.append([])
            for i, part in enumerate(self.cut.split(text or "")):
                runs[-1].append([part] if i % 2 else self.pieces(part))
        self.learn(set().union(*(pieces for run in runs for pieces in run[::2])))
        out = []
        for run in runs:
            ids, decoded = [], []
            for i, pieces in enumerate(run):
                if i % 2:
                    ids.append(array("I", [self.special[pieces[0]]]).tobytes())
                    decoded += pieces
                else:
                    found = [self.known[p] for p in pieces]
                    ids += [f[0] for f in found]
                    decoded += [f[1] for f in found]
            out.append((b"".join(ids), " ".join(decoded)))
        return out


@lru_cache(maxsize=1)
def _coder(content: str) -> TrieBPE:
    """One coder a worker process: its tables and word cache serve the worker's later tasks too."""
    return TrieBPE(content)


def bpe_encode(docs: DataFrame, vocab_path: str, text_col: str = "text", max_vocab_bytes: int = 64_000_000) -> DataFrame:
    """The input rows as ``row`` with n_tokens, ids_le32 (binary) and decoded (text of those ids).

    Defined results: null and empty texts, and texts of white space, have no tokens and decode to the empty
    text; texts of the added tokens become those; an empty table gives no rows.
    """
    with open(vocab_path, encoding="utf-8") as f:
        content = f.read(max_vocab_bytes + 1)
    if len(content) > max_vocab_bytes:
        raise ValueError(f"{vocab_path} has over {max_vocab_bytes} characters; it is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_le32 binary, decoded string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _coder(shared.value)
        for texts in by_bytes(batches, 2_000_000):
            both = bpe.encode_batch(texts)
            yield pd.DataFrame({"n_tokens": [len(i) // 4 for i, _ in both], "ids_le32": [i for i, _ in both],
                                "decoded": [d for _, d in both]})

    return with_row(docs, e=encode(F.col(f"`{text_col}`"))).select("row", "e.n_tokens", "e.ids_le32", "e.decoded")


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of what they decode to."""
    out = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocab())
    return out.select("row.doc_id", "n_tokens", F.sha2("ids_le32", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
