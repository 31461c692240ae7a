"""The pipeline's stages against brute force, and on edge rows."""

from __future__ import annotations

from array import array

from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_edges import ROWS

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if any(map(str.isalpha, t or ""))]
    rows = [(d, t) for d, t, _, _ in brute.line_dedup(rows)]
    groups = brute.components(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    rows = [(d, t) for d, t in rows if not brute.hits(t, items)[0]]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((d, len(ids), brute.sha(array("I", ids).tobytes()), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 100 < len(want) < 200


def test_stages_take_edge_rows_and_empty_tables(spark):
    from priorwise.llm.common import stage

    import corpus_pipeline

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string") \
        .withColumn("n_chars", F.char_length("text").cast("long")).withColumn("row", F.lit("clash")).withColumn("__gone", F.lit(1))
    for start, some in ((docs, True), (docs.where("doc_id < 0"), False)):
        now = start
        for name, step in corpus_pipeline.STAGES:
            out = stage(step(spark, now, SF), f"edge-{name}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == start.columns
            now = out
        ids = [r["doc_id"] for r in now.collect()]
        assert (sorted(i for i in ids if i is not None) == [1, 1, 4, 9, 11]) if some else ids == []


def test_near_duplicates_are_five_words_and_four_fifths(spark):
    """Near copies that 4-word shingles at 85 % keep: links and what goes, on rows of any length."""
    import corpus_pipeline

    words = [f"word{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]])),  # 41 of 51 shingles of five words, 43 of 51 of four
            (3, " ".join(f"long{i}" for i in range(100))), (4, " ".join([f"long{i}" for i in range(100)] + ["more"] * 3)),
            (5, " ".join(f"far{i}" for i in range(30))), (6, " ".join([f"far{i}" for i in range(22)] + ["gone"] * 8))]
    sets = {d: brute.shingles(t, 5) for d, t in rows}
    gone = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert gone == {2, 4} and brute.components(rows)[2][1] == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(set(sets) - gone)


def test_a_stage_evaluates_its_texts_once(spark):
    """A filter on a stage's result must not bring a second evaluation in a second worker."""
    import corpus_pipeline
    from priorwise.llm.common import table

    docs = table(spark, SF, "documents")
    for step in (corpus_pipeline.language, corpus_pipeline.contamination, corpus_pipeline.tokens):
        plan = step(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, step.__name__
