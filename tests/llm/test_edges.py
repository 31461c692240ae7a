"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

LONG = " ".join(f"long{i % 977} tale{i % 13}." for i in range(30_000)) + "\n" + "the same line that is long enough to count here\n" * 300
NEAR = " ".join(f"word{i}" for i in range(80))
ROWS = [(1, "Hello there,  world\tof lines", "en", "s"), (1, "Hello there,  world\tof lines", "en", "s"), (2, None, None, None),
        (3, "", "en", "s"), (None, "Hello there, world of lines", None, "s"), (None, None, None, None), (4, LONG, "en", "s"),
        (5, LONG, "en", "s"), (6, " \n\t\n", "fr", None), (7, "1234 -- 5678 !!", "fr", "s"), (8, "Hello there, world of lines", "fr", "s"),
        (9, NEAR, "en", "s"), (10, NEAR + " more", "en", "s"), (None, NEAR + " other", "en", "s"), (11, "<|endoftext|> ok", "en", "s")]
CLASH = ["row", "h", "id", "norm", "key", "node", "comp", "gone", "th", "keys", "pos", "token", "left", "kind", "score", "spans", "e"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def test_exact_dedup(spark, docs, none):
    from priorwise.llm.exact_dedup import exact_dedup

    got = sorted((tuple(r) for r in exact_dedup(docs, bucket_capacity=2).drop("text_sha256", "chain").collect()), key=str)
    want = []
    texts = [brute.re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in ROWS]
    for (d, *_), t in zip(ROWS, texts):
        ids = [r[0] for r, u in zip(ROWS, texts) if u == t]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((d, keep, len(ids), d == keep))
    assert got == sorted(want, key=str)
    assert exact_dedup(none).count() == 0


def test_line_dedup(docs, none):
    from priorwise.llm.line_dedup import line_dedup

    for min_docs in (5, 2):
        out = line_dedup(docs, min_docs=min_docs)
        assert out.select("row.*").columns == docs.columns
        got = sorted((tuple(r) for r in out.select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect()), key=str)
        assert got == sorted(brute.line_dedup([r[:2] for r in ROWS], min_docs=min_docs), key=str)
    assert line_dedup(none).count() == 0


def test_decontaminate(spark, docs, none):
    from priorwise.llm.decontaminate import decontaminate

    items = [(1, "hello THERE world"), (1, "hello THERE world"), (2, None), (3, ""), (4, "word1 " + NEAR), (None, "of lines")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    got = sorted(((r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate(docs, bench).collect()), key=str)
    assert got == sorted(((d, len(brute.words(t)), *brute.hits(t, items)) for d, t, *_ in ROWS), key=str)
    assert decontaminate(none, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate(docs, bench.where("item_id < 0")).collect()} == {0}


def test_jaccard(spark, docs, none):
    from priorwise.llm.jaccard_join import jaccard_components

    got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str)
    named = brute.components([(d, t) for d, t, *_ in ROWS if d is not None])
    want = [(d, *named[d]) for d, *_ in ROWS if d is not None]
    want += [(None, len(brute.shingles(ROWS[4][1])), 1), (None, 0, None), (None, len(brute.shingles(ROWS[13][1])), 9)]
    assert got == sorted(want, key=str)
    assert jaccard_components(none).count() == 0
    several = spark.createDataFrame([(1, NEAR), (1, "quite another text than that"), (3, "quite another text than that"), (4, NEAR)],
                                    "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(several).select("doc_id", "component_id").collect()) == [(1, 1), (1, 1), (3, 1), (4, 1)]


def test_language(docs, none):
    from priorwise.llm.language import LanguageModel, identify_languages, train_language_model

    model = train_language_model(docs)
    assert model.langs == ["en", "fr"]
    got = identify_languages(docs, model).collect()
    assert len(got) == len(ROWS)
    assert {r["lang_pred"] for r in got if not any(map(str.isalpha, r["row"]["text"] or ""))} == {"und"}
    assert all(r["lang_pred"] != "und" and 0 <= r["score"] <= 1 for r in got if any(map(str.isalpha, r["row"]["text"] or "")))
    assert identify_languages(none, model).count() == 0
    empty = train_language_model(none)
    assert empty.langs == [] and {r["lang_pred"] for r in identify_languages(docs, empty).collect()} == {"und"}
    assert isinstance(empty, LanguageModel)


def test_quality(spark, docs, none):
    from priorwise.llm.quality import score_quality, train_quality

    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, 1), (5, 0), (5, 1), (7, None), (9, 7), (None, 1)], "doc_id long, quality int")
    for known in (labels, labels.where("doc_id < 0")):
        weights = train_quality(docs, known, bits=12)
        got = score_quality(docs, weights).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        by_text = {}
        for r in got:
            assert by_text.setdefault(r["row"]["text"] or "", r["score"]) == r["score"]
        assert score_quality(none, weights).count() == 0


def test_html(spark):
    from priorwise.llm.html_extract import extract_main_text, train_crf

    page = "<nav><a href=/>Home</a></nav><article><h1>A title</h1>" + "".join(f"<p>Sentence {i}, and more.</p>" for i in range(9)) + "</article>"
    rows = [(1, page), (1, page), (2, None), (3, ""), (None, "<p"), (4, page[:200]), (5, "<article>" + "<p>A long page.</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("row", F.lit(1))
    crf = train_crf(pages.where("page_id < 5"))
    got = [(r["row"]["page_id"], r["text"]) for r in extract_main_text(pages, crf).collect()]
    assert len(got) == len(rows)
    assert [t for d, t in got if d in (2, 3, None)] == [""] * 3
    whole = [t for d, t in got if d == 1]
    assert whole[0] == whole[1] == "A title\n" + "\n".join(f"Sentence {i}, and more." for i in range(9))
    assert [t for d, t in got if d == 4][0] and whole[0].startswith([t for d, t in got if d == 4][0][:60])
    assert dict(got)[5].count("\n") == 19_999
    nothing = train_crf(pages.where("page_id = 2"))
    assert {t for _, t in [(0, r["text"]) for r in extract_main_text(pages, nothing).collect()]} == {""}
    assert extract_main_text(pages.where("page_id < 0"), crf).count() == 0


def test_html_sample_is_of_distinct_labelled_pages(spark):
    """Few pages with landmarks among many without, and many copies of one."""
    from priorwise.llm.html_extract import extract_main_text, train_crf, training_pages

    def page(i, tag):
        return f"<div class=menu><a href=/>Home {i}</a></div><{tag}>" + "".join(f"<p>Sentence {i} {j}, and more.</p>" for j in range(5)) + f"</{tag}>"

    few = [page(i, tag) for i, tag in enumerate(["article", "MAIN", "article", "main"])]
    other = [page(i, "div") for i in range(200)] + ["<article><nav>Home</nav></article>", "<script>'<main>'</script>", None, ""]
    pages = spark.createDataFrame([(h,) for h in few + other + few[:1] * 50], "html string")
    assert sorted(r["html"] for r in training_pages(pages, max_pages=10).collect()) == sorted(few)
    # the three labelled pages of the smallest hashes, each once
    hashes = {r["html"]: r["h"] for r in pages.where("html IS NOT NULL").selectExpr("html", "xxhash64(html) h").collect()}
    assert [r["html"] for r in training_pages(pages, max_pages=3).collect()] == sorted(few, key=hashes.get)[:3]
    # none of the four is among the three smallest hashes of all pages: nothing was learned of them
    assert not set(few) & set(sorted(hashes, key=hashes.get)[:3])
    crf = train_crf(pages, max_pages=3)
    texts = {r["row"]["html"]: r["text"] for r in extract_main_text(pages, crf).collect()}
    for i in range(4):
        assert texts[few[i]] == "\n".join(f"Sentence {i} {j}, and more." for j in range(5))
    assert training_pages(pages.where("html IS NULL")).count() == 0


def test_bpe(docs, none):
    import public_tokenizers
    from array import array
    from tokenizers import Tokenizer

    from priorwise.llm.bpe import bpe_encode, default_vocab

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(((r["row"]["doc_id"], bytes(r["ids_le32"]), r["n_tokens"]) for r in bpe_encode(docs, default_vocab()).collect()), key=str)
    ids = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in ROWS]
    assert got == sorted(((d, array("I", i).tobytes(), len(i)) for d, i in ids), key=str)
    assert bpe_encode(none, default_vocab()).count() == 0


def test_url_filter(spark):
    from priorwise.llm.url_filter import ALLOW, BLOCK, filter_urls

    urls = {"http://EXAMPLE.org/es/x": ("example.org", "/es/x", "example.org/es/", "block"), "https://a.example.org/en/12?q": ("a.example.org", "/en/12", "example.org/en/1", "block"),
            "x://example.org/en/2": ("example.org", "/en/2", "org/", "allow"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
            "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"), "http://b.com/DE/": ("b.com", "/DE/", None, "allow"), "http://org": ("org", "", None, "allow"),
            "no scheme.org/es/": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://": ("", "", None, "allow"), "a://h.com?x/fr/": ("h.com", "", None, "allow"),
            "a://" + "s." * 50 + "com/fr/" + "p" * 5000: ("s." * 50 + "com", "/fr/" + "p" * 5000, "com/fr/", "allow"), None: ("", "", None, "allow")}
    rows = [(i, u) for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("keys", F.lit(1)).withColumn("host", F.lit("clash"))
    got = filter_urls(pages, ALLOW, BLOCK).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["row"]["url"]]
    assert filter_urls(pages.where("page_id < 0"), ALLOW, BLOCK).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, [], []).collect()} == {"allow"}


def test_chat_empty(spark):
    from priorwise.llm.chat import rotate

    assert rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_components_of_chains(spark):
    from priorwise.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (300, 299), (299, 298)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 298: 298, 299: 298, 300: 298}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_jaccard_keeps_large_ids_beside_nulls(spark):
    from priorwise.llm.jaccard_join import jaccard_components

    far = 2 ** 53
    rows = [(far + 1, NEAR), (far + 3, NEAR + " more"), (None, "quite another text of five words"), (far + 5, "alone in here"), (0, "zero is an id too")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {(far + 1, far + 1), (far + 3, far + 1), (None, None), (far + 5, far + 5), (0, 0)}


def test_url_hosts_of_many_labels(spark):
    from priorwise.llm.url_filter import filter_urls

    deep = "a." * 16_000
    rows = [(1, f"http://{deep}org/x"), (2, f"http://{deep}com/de/"), (3, "http://org/x"), (4, "http://" + "." * 20_000 + "/en/1")]
    out = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), ["org/"], ["com/de/", "/en/1"], default="allow")
    assert {r["row"]["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()} == \
        {1: ("org/", "allow"), 2: ("com/de/", "block"), 3: ("org/", "allow"), 4: ("/en/1", "block")}


def test_html_quotes_and_formulas():
    from priorwise.llm.html_blocks import leaf_blocks

    def texts(page):
        return [b.text for b in leaf_blocks(page)]

    assert texts('<p class="a"">First text</p><p class="b">Second.</p>') == ["First text", "Second."]
    assert texts("<p class=john's>One</p><p>it's</p>") == ["One", "it's"]
    assert texts('<p title="a > b" id = \'x > y\'>q</p>') == ["q"]
    assert texts('<p title="never closed>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be <object>shown</object>.</p>") == ["Let x=2 be shown."]
    assert texts("<p " + 'a="' * 50_000 + ">end") == ["end"]
