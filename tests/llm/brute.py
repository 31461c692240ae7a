"""Plain re-statements of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re

WS = " \t\n\x0b\x0c\r"


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def line_dedup(rows, min_chars=40, min_docs=5):
    """rows: (id, text) -> list of (id, kept text, lines, dropped)."""
    keys = [[lower(line.strip(WS)) for line in (t or "").split("\n")] for _, t in rows]
    held: dict[str, list[int]] = {}
    for i, ks in enumerate(keys):
        for k in set(ks):
            if len(k) >= min_chars:
                held.setdefault(k, []).append(i)
    owner = {}
    for k, at in held.items():
        if len(at) >= min_docs:
            owner[k] = max((rows[i][0] for i in at if rows[i][0] is not None), default=None)
    out = []
    for (d, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, ks) if k not in owner or owner[k] == d]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def components(rows, percent=85):
    """rows: (id, text), ids distinct -> {id: (set size, component)}."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def hits(text, items, n=10):
    """(words hit, sorted ids of items found)."""
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        iw = words(t)
        size = min(len(iw), n)
        windows = {tuple(iw[i:i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item_id)
    return len(hit), sorted(str(i) for i in found if i is not None)


def sha(s) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def contract_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring_dedup(rows, size=20):
    """rows: (id, text), in the order in which documents come -> list of (id, words, kept words)."""
    seen, out = set(), []
    for d, t in rows:
        w, gone = contract_words(t), set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            if key in seen:
                gone |= set(range(i, i + size))
            seen.add(key)
        out.append((d, len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def runs(w, least=24, copies=3):
    """All (start, length, period): maximal stretches by every lag, each under its smallest period."""
    n, found = len(w), {}
    for q in range(1, n // copies + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, copies * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def whitening(vectors, k=16):
    """(n, sums, eigenvalues, axes, trace) of distinct integer vectors, by numpy."""
    import numpy as np

    fit = np.array(sorted(set(map(tuple, vectors))), float)
    c = fit - fit.mean(axis=0)
    v = c.T @ c / len(fit)
    values, axes = np.linalg.eigh(v)
    return len(fit), fit.sum(axis=0), values[::-1][:k], axes[:, ::-1][:, :k], np.trace(v)
