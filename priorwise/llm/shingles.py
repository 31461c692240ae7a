"""Hashed word shingles of many texts at once, with numpy.

A word's hash is a polynomial over its bytes modulo 2**64 with a random value for each byte, read off
prefix sums, so one pass over the bytes hashes all words of a chunk of texts. Hashes are finalised by
a mixer; they depend on the fixed seed alone, not on process or partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: powers differ in all but a few low bits
_BASE_INV = pow(_BASE, -1, 2**64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 250_000


class _Powers:
    """Powers of the base and of its inverse, grown as far as the longest chunk needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE_INV, np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK bytes (or one text), with the place of the first."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, texts[start:]


def _run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run [start, end) of bytes; no run starts at 0."""
    up, down = _POWERS.of(len(buf) + 1)
    sums = np.cumsum(_BYTE[buf] * up[:-1], dtype=np.uint64)
    return mix((sums[ends - 1] - sums[starts - 1]) * down[starts])


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with white space around each, and where each begins (and the end)."""
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    return buf, np.cumsum([1] + [len(t) + 1 for t in texts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in turn, and where each text's words begin (and the end)."""
    buf, begins = _joined(texts)
    white = _WHITE[buf]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    return _run_hashes(buf, starts, ends), np.searchsorted(starts, begins)


def token_hashes(texts: list[bytes], kinds: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like word_hashes for runs of one kind of byte (kind 0 parts them), with bytes folded by ``fold``.

    Also gives each run's kind, and whether it has two bytes or more, all of them folded: words in capitals.
    """
    buf, begins = _joined(texts)
    kind = kinds[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = edge, np.append(edge[1:], len(buf))
    inside = kind[starts] > 0
    starts, ends = starts[inside], ends[inside]
    folded = fold[buf]
    upper = np.cumsum((folded != buf) & (kind == 1))
    caps = (upper[ends - 1] - upper[starts - 1] == ends - starts) & (ends - starts > 1)
    return _run_hashes(folded, starts, ends), np.searchsorted(starts, begins), kind[starts], caps


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes.

    A-Z count as a-z, words are runs without ``[\\x20\\x09-\\x0D]``. A text of fewer words, but not none,
    has one shingle, the whole sequence; a text without words, or null, has none.
    """
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    raw = [t.encode().lower() if t else b"" for t in texts]  # lower() of bytes changes A-Z only
    for _, part in chunks(raw):
        words, at = word_hashes(part)
        n = len(words) - k + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for j in range(k):
            grams += words[j:j + len(grams)] * factors[j]
        grams = mix(grams)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= k:
                yield np.unique(grams[a:b - k + 1])
            elif b > a:
                short = (words[a:b] * factors[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64))
            else:
                yield grams[:0]


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set as two signed integers."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
