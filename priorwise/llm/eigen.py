"""Leading eigenpairs of a symmetric matrix: Householder reflections, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, unit reflectors) of H matrix H; the reflector k acts on the rows from k + 1 on."""
    a = np.array(matrix, float)
    size, reflectors = len(a), []
    for k in range(size - 2):
        v = a[k + 1:, k].copy()
        lead = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= lead
        length = np.linalg.norm(v)
        if length:
            v /= length
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = lead
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: for each number in ``at``, how many eigenvalues lie below it."""
    tiny = np.finfo(float).tiny * max(1.0, float((off ** 2).max(initial=0)))
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    with np.errstate(over="ignore"):
        for d, e in zip(diagonal, np.r_[0.0, off]):
            q = d - at - e * e / q
            q = np.where(np.abs(q) < tiny, -tiny, q)
            count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bits."""
    reach = np.abs(np.r_[0, off]) + np.abs(np.r_[off, 0])
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    width = _EPS * max(np.abs(low[0]), np.abs(high[0]))
    low, high = low - 2 * width, high + 2 * width
    rank = len(diagonal) - np.arange(k)  # so many eigenvalues lie at or below the wanted one
    for _ in range(2000):
        middle = (low + high) / 2
        if not ((high - low > 2 * _EPS * np.abs(middle)) & (middle > low) & (middle < high) & (high - low > width * 1e-3)).any():
            break
        under = below(diagonal, off, middle) >= rank
        low, high = np.where(under, low, middle), np.where(under, middle, high)
    return (low + high) / 2


class _Shifted:
    """LU factors, with row exchanges, of a tridiagonal matrix less ``shift`` on its diagonal."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, shift: float):
        n = len(diagonal)
        norm = max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0))) or 1.0
        d, up, up2 = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
        factor, swap = [0.0] * n, [False] * n
        for i, low in enumerate(off.tolist()):
            if abs(d[i]) >= abs(low):
                factor[i] = low / d[i] if d[i] else 0.0
                d[i + 1] -= factor[i] * up[i]
            else:
                swap[i], factor[i] = True, d[i] / low
                d[i], up[i], d[i + 1], up2[i], up[i + 1] = low, d[i + 1], up[i] - factor[i] * d[i + 1], up[i + 1], -factor[i] * up[i + 1]
        self.d = [x if abs(x) > _EPS * norm else _EPS * norm for x in d]
        self.up, self.up2, self.factor, self.swap = up, up2, factor, swap

    def solve(self, b: np.ndarray) -> np.ndarray:
        y, n = b.tolist(), len(b)
        for i in range(n - 1):
            if self.swap[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= self.factor[i] * y[i]
        for i in reversed(range(n)):
            rest = self.up[i] * y[i + 1] if i + 1 < n else 0.0
            rest += self.up2[i] * y[i + 2] if i + 2 < n else 0.0
            y[i] = (y[i] - rest) / self.d[i]
        return np.array(y)


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 6) -> np.ndarray:
    """Unit eigenvectors, as columns, of the falling ``values``: inverse iteration.

    Values closer than a thousandth of the matrix's norm to the one before are a cluster: their vectors are made
    orthogonal to those before in each step, twice, as nearly equal values have nearly equal solutions.
    """
    norm = float((np.abs(diagonal) + np.abs(np.r_[0, off]) + np.abs(np.r_[off, 0])).max()) or 1.0
    rng, found, start, last = np.random.default_rng(11), np.zeros((len(diagonal), len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            start = j
        shift = min(value, last - 10 * _EPS * norm) if j > start else value
        last, factors = shift, _Shifted(diagonal, off, shift)
        y = rng.standard_normal(len(diagonal))
        for _ in range(steps):
            for _ in range(2):
                y -= found[:, start:j] @ (found[:, start:j].T @ y)
            y = factors.solve(y / np.linalg.norm(y))
            y /= np.abs(y).max()
        for _ in range(2):
            y -= found[:, start:j] @ (found[:, start:j].T @ y)
        found[:, j] = y / np.linalg.norm(y)
    return found


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, min(k, len(diagonal)))
    vectors = vectors_of(diagonal, off, values)
    for i in reversed(range(len(reflectors))):
        v = reflectors[i]
        vectors[i + 1:] -= 2 * np.outer(v, v @ vectors[i + 1:])
    return values, vectors / np.linalg.norm(vectors, axis=0)
