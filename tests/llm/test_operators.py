"""The operators against SQL, brute force, the tokenizer library and held-out labels."""

from __future__ import annotations

import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import compare, duck

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def llm():
    from priorwise.llm import registry

    registry.load_all()
    return registry


def docs_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["op1_chat_rotation", "op2_line_dedup", "op5_decontaminate", "op9_exact_dedup", "op10_url_filter"])
def test_against_sql(spark, llm, name):
    r = compare(spark, duck(SMALL), name, llm.QUERIES[name], llm.ORACLES[name], SMALL)
    assert r["status"] == "match", r


def test_every_operator_is_registered(entry_mod):
    names = entry_mod.queries()
    for n in range(1, 11):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert "pipeline" in names


def test_jaccard_components_match_brute_force(spark, llm):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in llm.QUERIES["op6_jaccard_join"](spark, SMALL).collect()}
    assert got == brute.components(docs_of(spark, SMALL))


def test_jaccard_pivots_and_stragglers_lose_no_link(spark):
    """A hot group of near copies, few of them linked with each other: all rounds and the salted shingles."""
    from priorwise.llm.jaccard_join import jaccard_components

    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        text = base[:]
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    want = brute.components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"pivot_rounds": (1, 2), "hot_cell": 5, "sketch_bits": 8}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, **options).collect()}
        assert got == want
    assert 1 < len({c for _, c in want.values()}) < 70


def test_jaccard_stragglers_are_near(spark):
    """Texts that share their rare shingles and still differ in too many are no candidates; all that link are."""
    from pyspark.sql import functions as F

    from priorwise.llm.jaccard_join import _posted, _stragglers

    rng = random.Random(5)
    rows = []
    for i in range(80):
        text = [f"w{j}" for j in range(150)]
        for j in rng.sample(range(4, 150), 2 if i < 70 else 1):
            text[j] = f"x{i}"
        rows.append((i, " ".join(text)))
    sets = {d: frozenset(brute.shingles(t)) for d, t in rows}
    linked = {(d, e) for d in sets for e in sets if d < e and 100 * len(sets[d] & sets[e]) >= 85 * len(sets[d] | sets[e])}
    _, _, bitmaps, postings, verifier = _posted(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4, 85, 20, 50_000)
    pairs = _stragglers(postings.withColumn("comp", F.col("node")), bitmaps, 85)
    got = {tuple(sorted(r)) for r in pairs.select("left", "right").collect()}
    verifier.close()
    met = postings.alias("a").join(postings.alias("b"), "token").where("a.node < b.node").select("a.node", "b.node").distinct().count()
    assert linked <= got and linked
    assert len(got) < met / 4


def test_jaccard_links_are_all_counted(spark):
    """Links inside a group of near copies count as well; equal sets are one class."""
    from priorwise.llm.jaccard_join import jaccard_links

    rng = random.Random(4)
    rows = []
    for i in range(40):
        text = [f"w{j}" for j in range(120)]
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    rows += [(100, rows[7][1].upper()), (101, "quite alone here now"), (102, None), (103, " ")]
    sets = {d: frozenset(brute.shingles(t)) for d, t in rows}
    of = {d: min(e for e in sets if sets[e] == s) if s else d for d, s in sets.items()}
    links = {d: sum(100 * len(sets[d] & sets[e]) >= 85 * len(sets[d] | sets[e]) for e in set(of.values()) if e != of[d] and sets[e])
             if sets[d] else 0 for d in sets}
    want = {(d, len(sets[d]), of[d], links[d]) for d in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"hot_cell": 5, "sketch_bits": 8}):
        assert {tuple(r) for r in jaccard_links(docs, **options).collect()} == want
    assert sum(links[d] for d in set(of.values())) // 2 > 40 - 1
    several = spark.createDataFrame([(1, "one two three four five"), (1, "quite another text than that"), (3, "quite another text than that"),
                                     (None, "no id here at all")], "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_links(several).collect()), key=str) == [(1, 2, 1, 0), (1, 2, 1, 0), (3, 2, 1, 0), (None, 2, None, 0)]


def test_shingle_sets_count_distinct_shingles():
    from priorwise.llm.shingles import shingle_sets

    rng = random.Random(1)
    texts = [None, "", " \n", "A b", "a B", "a b c d", "a b c d a b c d a b c d"] + \
        [" ".join(rng.choice("abé") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    sets = [frozenset(s.tolist()) for s in shingle_sets(texts, 4)]
    for a, s in zip(texts, sets):
        assert len(s) == len(brute.shingles(a))
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(brute.shingles(texts[i]) & brute.shingles(texts[j]))


def test_language_held_out_accuracy(spark, llm):
    truth = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    got = llm.QUERIES["op7_language"](spark, MEDIUM).join(truth, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == truth.count() and 200 < len(held) < 300
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_spans_of_a_mixed_text():
    from priorwise.llm.language import LanguageModel, Words, N_SCRIPTS, clean

    texts = {"aa": "lam lomo lal mola " * 40, "bb": "zir zeri riz irze " * 40, "ru": "да нет это как " * 40}
    counts = {}
    for lang, t in texts.items():
        w = Words([clean(t)], 12)
        counts[lang] = np.bincount(np.r_[w.cells, w.words, w.scripts + (2 << 12)], minlength=(2 << 12) + N_SCRIPTS)
    model = LanguageModel(counts, bits=12)
    mixed = "Lam lomo, lal mola! lomo lam lal lomo lam lal... zir zeri riz irze; zeri zir riz irze zeri zir riz irze."
    (lang, score, spans), = model.identify([mixed])
    assert [s[0] for s in spans] == ["aa", "bb"] and mixed[spans[1][1]:].startswith("zir") and 0 < score < 1
    assert model.identify(["это нет"])[0][0] == "ru"
    assert model.identify([None, "", "123 ½ !?"]) == [("und", 0.0, [])] * 3


def test_viterbi_shortcut_agrees_with_the_recursion():
    from priorwise.llm.language import LanguageModel

    rng = np.random.default_rng(3)
    model = LanguageModel({}, penalty=3.0)
    for _ in range(200):
        s = -rng.exponential(1.0, (12, 3))
        path = model.path(s)
        best = None
        value, score = s[0].copy(), None
        for t in range(1, 12):
            value = np.maximum(value, value.max() - 3.0) + s[t]
        score = s[np.arange(12), path].sum() - 3.0 * (np.diff(path) != 0).sum()
        best = value.max()
        assert score == pytest.approx(best)


def test_quality_held_out_ranking(spark, llm):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = llm.QUERIES["op3_quality"](spark, MEDIUM)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(rows) > 100 and auc >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_html_extraction(spark, llm):
    """The pages' articles, exactly."""
    import html
    import re

    rows = llm.QUERIES["op4_html_extract"](spark, MEDIUM).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        body = page[page.index("<article>") + 9:].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def test_html_blocks():
    from priorwise.llm.html_blocks import leaf_blocks

    page = ("<title>t</title><script>var a='<p>';</script><p>a &lt; b<p>c<br>d <a href=x>e</a>&nbsp;f<ul><li>g<li>h</ul>"
            "<!-- x --><table><tr><td class='Big menu'>i<td>j</table>k < l<div id=main>m<p>n</div>o<p title='")
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["a < b", "c d e f", "g", "h", "i", "j", "k < l", "m", "n", "o"]
    assert blocks[1].linked == 1 and blocks[2].tags == ("ul", "li") and blocks[4].names == ("big", "menu")
    assert leaf_blocks(None) == leaf_blocks("") == leaf_blocks("<p> </p>") == []
    assert leaf_blocks("<" * 3000 + "a\"" * 3000)  # no blow-up


def test_crf_gradient_and_decoding():
    """Marginals and the best labelling by enumeration."""
    import itertools

    from priorwise.llm.html_extract import Crf

    rng = np.random.default_rng(0)
    crf = Crf(4)
    crf.moves, crf.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    e = rng.normal(size=5).tolist()

    def score(y):
        return crf.start[y[0]] + sum(x for x, l in zip(e, y) if l) + sum(crf.moves[a, b] for a, b in zip(y, y[1:]))

    ways = list(itertools.product((0, 1), repeat=5))
    chance = np.exp([score(y) for y in ways])
    chance /= chance.sum()
    one, pairs, first = crf._marginals(e)
    assert np.allclose(one, [sum(c for c, y in zip(chance, ways) if y[t]) for t in range(5)])
    assert np.allclose(pairs[0, 1], sum(c * sum((a, b) == (0, 1) for a, b in zip(y, y[1:])) for c, y in zip(chance, ways)))
    assert tuple(crf.decode(e)) == max(ways, key=score)


def test_bpe_equals_the_library(spark, llm):
    import public_tokenizers
    from tokenizers import Tokenizer

    from priorwise.llm.bpe import TrieBPE

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    alphabet = "abcdefgABCΣσς'sdtmrvel 019#!éÉǅİßﬁ中文\n\t ́ ½²\x1c\x85😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("aabeinstr") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|startoftext|>", "x<|ENDOFTEXT|>", "", None, "aaaaaaaaaaaaaaaaaa", "ab" * 100]
    coder = TrieBPE(open(path, encoding="utf-8").read(), cache_words=700, trie_words=50)
    for i in range(0, len(texts), 300):
        for text, (ids, decoded) in zip(texts[i:i + 300], coder.encode_batch(texts[i:i + 300])):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert array("I", want).tobytes() == ids, text
            assert library.decode(want, skip_special_tokens=False) == decoded
    for r in llm.QUERIES["op8_bpe"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").collect():
        want = library.encode(r["text"], add_special_tokens=False).ids
        assert (len(want), brute.sha(array("I", want).tobytes()), brute.sha(library.decode(want, skip_special_tokens=False))) == \
            (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])


def test_extendible_directory():
    from priorwise.llm.exact_dedup import build_directory

    rng = random.Random(2)
    for capacity in (1, 3, 10, 1000):
        counts = {rng.randrange(64): rng.randrange(9) for _ in range(30)}
        depth, cells = build_directory(counts, 6, capacity)
        assert len(cells) == 2 ** depth and sorted(set(cells)) == list(range(len(set(cells)))) and cells == sorted(cells)
        load: dict[int, int] = {}
        for cell, n in counts.items():
            load[cells[cell >> (6 - depth)]] = load.get(cells[cell >> (6 - depth)], 0) + n
        assert all(n <= capacity or depth == 6 for n in load.values())


def test_bloom_cascade_is_exact_over_its_universe():
    from priorwise.llm.url_filter import Bloom, Cascade

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    listed, others = keys[:500], keys[500:]
    for rate in (0.5, 0.1, 0.001):
        first = Bloom(listed, 1, rate)
        cascade = Cascade(listed, others[first.has(others)], first)
        assert cascade.has(listed).all() and not cascade.has(others).any()


def test_line_runs_many_batches(spark):
    """More batches than a level holds: compaction, deltas and the last merge."""
    from priorwise.llm.line_dedup import line_dedup

    rng = random.Random(8)
    pool = [f"{'Line' if i % 2 else 'line'} number {i} of a pool of long enough lines" for i in range(40)]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), f"short {i}", "  " + rng.choice(pool).upper() + "\t"])
                          for _ in range(rng.randint(0, 6)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup(docs, batches=7, fanout=2).select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.line_dedup(rows))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_decontamination_in_shards_and_spans(spark):
    from priorwise.llm.decontaminate import decontaminate

    items = [(i, " ".join(f"q{i}w{j}" for j in range(14))) for i in range(12)] + [(50, "one two"), (51, "..."), (None, "no id here")]
    text = "Start! Q3W0 " + ", ".join(f"Q3w{j}" for j in range(1, 12)) + " end. One... two; NO id-here"
    docs = spark.createDataFrame([(1, text), (2, "clean words only"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (16_000_000, 150):
        got = {r["row"]["doc_id"]: r for r in decontaminate(docs, bench, max_shard_bytes=size).collect()}
        n, ids = brute.hits(text, items)
        assert (got[1]["n_hit"], got[1]["items"]) == (n, ids) and ids == ["3", "50"]
        assert text[got[1]["spans"][0]["start"]:].startswith("Q3W0") and got[1]["spans"][-1]["end"] == len(text)
        assert got[2]["n_hit"] == got[3]["n_hit"] == got[3]["n_words"] == 0


def test_chat_blocks_and_masks(spark):
    from priorwise.llm.chat import rotate

    rows = [(1, t, ["ann", "bob", "<|x"][t % 3], f"message {t} <|end|>") for t in range(10)] + [(None, None, None, None), (2, 0, "", "hi")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("extra"))
    got = rotate(turns, block=4).collect()
    one = {(r["perspective"], r["block_no"]): r for r in got if r["conv"] == 1}
    assert set(one) == {(p, b) for p in ("ann", "bob", "<|x") for b in range(3)}
    for (who, block), r in one.items():
        said = [r["text"][m["start"]:m["end"]] for m in r["mask"]]
        mine = [t for t in range(4 * block, min(4 * block + 4, 10)) if ["ann", "bob", "<|x"][t % 3] == who]
        assert said == [f"message {t} <​|end|>\n<|".removesuffix("<|").replace("\n", "<|end|>\n") for t in mine]
        assert r["text"].count("<|assistant|>") == len(mine) and r["text"].count("<|end|>") == r["n_messages"]
    assert [r["text"] for r in got if r["conv"] == 2] == ["<|assistant|>\nhi<|end|>\n" * 2]
    assert [(r["perspective"], r["n_messages"]) for r in got if r["conv"] is None] == [("unknown", 2)]
