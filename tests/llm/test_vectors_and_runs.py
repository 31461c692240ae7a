"""Whitening, repeated passages and periodic runs against brute force, with their edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def llm():
    from priorwise.llm import registry

    registry.load_all()
    return registry


def docs_of(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())


# -- whitening


def matrices():
    rng = np.random.default_rng(3)

    def with_values(values):
        q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
        m = q @ np.diag(values) @ q.T
        return (m + m.T) / 2

    a = rng.standard_normal((50, 200))
    return {"random": a @ a.T, "equal": np.eye(20), "zero": np.zeros((4, 4)), "one": np.array([[3.0]]), "two": with_values([2.0, 1.0]),
            "clusters": with_values(np.repeat([9, 4, 1, 1e-3], 10)), "close": with_values(1 + 1e-9 * np.arange(60)),
            "apart": with_values(10.0 ** -np.arange(12)), "blocks": np.kron(np.eye(5), [[2.0, 1.0], [1.0, 2.0]])}


@pytest.mark.parametrize("name", matrices())
def test_leading_pairs(name):
    from priorwise.llm.eigen import leading_pairs

    m = matrices()[name]
    k = min(16, len(m))
    values, axes = leading_pairs(m, k)
    size = max(1.0, np.abs(m).max())
    assert np.abs(values - np.linalg.eigvalsh(m)[::-1][:k]).max() < 1e-13 * size * len(m)
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
    assert np.abs(m @ axes - axes * values).max() < 1e-12 * size


def check_whitening(rows, vectors, k=16):
    """rows: results with id; vectors: {id: integer vector}."""
    n, sums, values, axes, trace = brute.whitening(vectors.values(), k)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(vectors)
    signs = None
    for i, v in vectors.items():
        got = by[i]
        assert sorted(got) == list(range(1, len(values) + 1))
        want = (np.array(v, float) - sums / n) @ axes / np.sqrt(values)
        have = np.array([got[c]["whitened"] for c in sorted(got)])
        if signs is None and (np.abs(want) > 1e-6).all():
            signs = np.sign(want * have)
        assert np.allclose(np.abs(have), np.abs(want), rtol=1e-6, atol=1e-8)
        assert {r["n"] for r in got.values()} == {n}
        assert {int(r["deviation"]) for r in got.values()} == {sum((n * int(x) - int(s)) ** 2 for x, s in zip(v, sums))}
        assert np.allclose([got[c]["explained"] for c in sorted(got)], values / trace, rtol=1e-9)
        assert max(r["identity_error"] for r in got.values()) < 1e-9
    for i, v in vectors.items():  # one sign a component for all rows
        want = (np.array(v, float) - sums / n) @ axes / np.sqrt(values)
        assert np.allclose(np.array([by[i][c]["whitened"] for c in sorted(by[i])]) * signs, want, rtol=1e-5, atol=1e-7)


def test_whitening_query(spark, llm):
    rows = llm.QUERIES["op11_whitening"](spark, SMALL).collect()
    raw = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check_whitening(rows, {r["vec_id"]: tuple(int(np.floor(64.0 * c)) + 1_000_000 for c in r["embedding"]) for r in raw})


def test_whitening_edges(spark):
    from priorwise.llm.whitening import lattice, whiten

    rng = random.Random(2)
    inf, nan = float("inf"), float("nan")
    sound = [(i, [rng.uniform(-3, 3) for _ in range(5)]) for i in range(40)] + [(100 + i, [0.5, 0.25, -1.0, 2.0, 0.0]) for i in range(30)]
    rows = [*sound, sound[0], (200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [nan, 0.0, 0.0, 0.0, 0.0]), (203, [0.0, inf, 0.0, 0.0, 0.0]),
            (204, [0.0, -inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("*", *[F.lit(c).alias(c) for c in ("id", "component", "n", "pos", "block")])
    points = df.withColumn("x", lattice(F.col("e")))
    found = whiten(points, components=3).collect()
    vectors = {i: tuple(int(np.floor(64 * c)) + 1_000_000 for c in e) for i, e in sound}
    assert len(found) == 3 * (len(sound) + 1)  # the repeated row comes twice
    check_whitening(found, vectors, 3)
    # one distinct vector, two of them, no entries, no rows, a null id, lengths that differ
    same = spark.createDataFrame([(1, [5, 6]), (2, [5, 6])], "vec_id long, x array<long>")
    assert whiten(same).count() == 0
    two = whiten(same.unionByName(spark.createDataFrame([(None, [7, 6])], same.schema))).collect()
    assert sorted((r["vec_id"] or 0, r["component"], int(r["deviation"]), round(abs(r["whitened"]), 9)) for r in two) == \
        [(0, 1, 4, 1.0), (1, 1, 1, 1.0), (2, 1, 1, 1.0)] or {r["n"] for r in two} == {2}
    assert whiten(same.where("vec_id < 0")).count() == 0
    assert whiten(spark.createDataFrame([(1, [])], same.schema)).count() == 0
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [1]), (2, [1, 2])], same.schema))
    # beyond 64 bits everything stays exact
    far = {i: tuple(rng.randrange(-2 ** 58, 2 ** 58) for _ in range(3)) for i in range(9)}
    rows = whiten(spark.createDataFrame([(i, list(v)) for i, v in far.items()], same.schema), components=2).collect()
    sums = [sum(v[j] for v in far.values()) for j in range(3)]
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == {i: sum((9 * x - s) ** 2 for x, s in zip(v, sums)) for i, v in far.items()}


# -- repeated passages


def kept(out):
    return sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()), key=str)


def wanted(rows, size=20):
    return sorted(((d, n, n - len(w), " ".join(w)) for d, n, w in brute.substring_dedup(rows, size)), key=str)


def test_substring_query(spark, llm):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in llm.QUERIES["op12_substring_dedup"](spark, SMALL).collect()}
    assert got == {d: (n, n - len(w), brute.sha(" ".join(w))) for d, n, w in brute.substring_dedup(docs_of(spark))}
    assert any(r[1] for r in got.values())


@pytest.mark.parametrize("size,bits", [(20, 29), (5, 29), (4, 3), (1, 29)])
def test_substring_random(spark, size, bits):
    """Few words, so that windows repeat within and across documents; with a sketch of too few cells, too."""
    from priorwise.llm.substring_dedup import substring_dedup

    rng = random.Random(size)
    passages = [" ".join(f"p{rng.randrange(6)}" for _ in range(rng.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i * 7 - 300, rng.choice([" ", "\n", " \t "]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert kept(substring_dedup(df, size=size, max_bits=bits)) == wanted(rows, size)


def test_substring_edges(spark):
    from priorwise.llm.substring_dedup import substring_dedup

    passage = " ".join(f"word{i}" for i in range(30))
    long = " ".join(f"l{i % 5000}" for i in range(40_000))
    rows = [(5, passage), (3, "x " + passage + "\ty"), (3, "x " + passage + "\ty"), (None, passage + " z"), (None, None), (7, None), (8, ""), (9, " \n\t"),
            (2 ** 53 + 1, long), (2 ** 53 + 2, long), (11, "a b " * 25), (12, " ".join(passage.split()[:20])), (13, " ".join(passage.split()[:19]))]
    clash = ["row", "doc", "mark", "low", "high", "place", "least", "ranges", "d", "k1"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in clash])
    out = substring_dedup(df)
    assert out.select("row.*").columns == df.columns
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    once = [r for i, r in enumerate(first) if r not in first[:i]]
    want = {r[0]: r[1:] for r in wanted(once + [rows[3]])}
    got = kept(out)
    assert len(got) == len(rows) and (None, 0, 0, "") in got
    assert sorted(set(got), key=str) == sorted({(d, *v) for d, v in want.items()} | {(None, 0, 0, "")}, key=str)
    assert substring_dedup(df.where("doc_id < 0")).count() == 0


# -- periodic runs


def test_runs_random():
    from priorwise.llm.periodic import periodic_runs, surviving_segments

    rng = random.Random(8)
    seen = 0
    for _ in range(400):
        n, kinds = rng.choice([10, 24, 30, 60, 150, 400]), rng.choice([1, 2, 3, 6, 30, 200])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            p, a, size = rng.randint(1, max(1, n // 4)), rng.randrange(n), rng.randint(1, n)
            for i in range(a + p, min(n, a + size)):
                w[i] = w[i - p]
            if rng.random() < 0.3:
                w[rng.randrange(n)] = rng.randrange(kinds)
        want = brute.runs(w)
        seen += len(want)
        assert periodic_runs(w) == want
        segments = surviving_segments(np.array(w), 24, 3, block=rng.choice([1, 7, 1024]))
        for low, high in segments:
            assert high - low >= 24 and min(w[low:high].count(x) for x in set(w[low:high])) >= 3
        assert all(any(low <= a and a + size <= high for low, high in segments) for a, size, _ in want)
    assert seen > 100


def test_runs_of_long_texts():
    from priorwise.llm.periodic import periodic_runs

    assert periodic_runs(["a"] * 60_000) == [(0, 60_000, 1)]
    assert periodic_runs([i % 777 for i in range(60_000)]) == [(0, 60_000, 777)]
    split = [x for i in range(2000) for x in [f"r{i}", *(["a", "b"] * 15)]]  # a rare word after each run
    assert periodic_runs(split) == [(31 * i + 1, 30, 2) for i in range(2000)]


def whole_contract(doc_id, text):
    w = brute.contract_words(text)
    h = zlib.crc32(str(doc_id).encode())
    if w and doc_id is not None and not h % 10:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute.runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], brute.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark, llm):
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])
           for r in llm.QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    rows = [r for r in docs_of(spark) if len(brute.contract_words(r[1])) < 1500]
    assert len(rows) > 150 and sum(bool(got[d][0]) for d, _ in rows) > 5
    for d, t in rows:
        assert got[d] == whole_contract(d, t), d


def test_runs_edges(spark):
    from priorwise.llm.periodic import detect_periodic, greatest

    tied = " ".join(["a", "b"] * 12 + ["stop"] + ["c", "d"] * 12)
    rows = [(1, None), (2, ""), (3, " \n"), (None, tied), (2 ** 53 + 1, tied), (2 ** 53 + 1, tied), (5, "a b " * 30), (6, "x " * 23), (7, "x " * 24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(0).alias(c) for c in ("row", "d", "runs", "best", "n_words")])
    out = detect_periodic(df)
    assert out.select("row.*").columns == df.columns
    got = [(r["row"]["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed_text"]) for r in out.collect()]
    both = (49, [(0, 24, 2), (25, 24, 2)], (0, 24, 2), "a b stop c d")
    assert sorted(got, key=str) == sorted([(1, 0, [], None, ""), (2, 0, [], None, ""), (3, 0, [], None, ""), (None, *both), (2 ** 53 + 1, *both), (2 ** 53 + 1, *both),
                                           (5, 30, [(0, 30, 1)], (0, 30, 1), "a b"), (6, 23, [], None, " ".join(["x"] * 23)), (7, 24, [(0, 24, 1)], (0, 24, 1), "x")], key=str)
    assert greatest([(9, 30, 1), (0, 60, 2), (0, 24, 1)]) == (0, 60, 2)
    assert detect_periodic(df.where("doc_id < 0")).count() == 0
    from priorwise.llm.periodic import replanted

    assert replanted(["a"], None) == ["a"] and replanted([], 10) == []
