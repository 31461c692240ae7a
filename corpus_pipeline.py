"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, tokens.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read again as the next one's docs. All but the last return the columns of documents; rows with
other columns keep them. An empty table goes through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.bpe import bpe_encode, default_vocab
from priorwise.llm.common import stage, table
from priorwise.llm.decontaminate import decontaminate
from priorwise.llm.jaccard_join import jaccard_components
from priorwise.llm.language import identify_languages, op7_model
from priorwise.llm.line_dedup import line_dedup
from priorwise.llm.registry import QUERIES, register


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (``und``: null text, no letter) go; a missing lang is filled in.

    The model is learned from the documents that carry a language, less the held-out fold.
    """
    found = identify_languages(docs, op7_model(docs)).where("lang_pred <> 'und'")
    return found.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more hold stay in the one with the largest doc_id; n_chars follows the text."""
    left = line_dedup(docs)
    text = F.when(F.col("row.text").isNull(), F.col("row.text")).otherwise(F.col("kept_text"))
    return left.select(F.col("row").withField("text", text).withField("n_chars", F.char_length("kept_text").cast("long")).alias("row")) \
        .select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays. Rows without an id all stay.

    Links are those of near copies: Jaccard similarity of 0.8 or more over five words (op6's contract has values of its own).
    """
    members = jaccard_components(docs.select("doc_id", "text"), k=5, percent=80)
    gone = members.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; texts of any length are scanned whole; rows that repeat are judged alike; an empty
    benchmark lets all stay.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens and of what they decode to.

    Null, empty and blank texts have no tokens and the digests of nothing; texts of any length are encoded whole; each
    row gets its own line, repeated ones too; a null id is carried.
    """
    out = bpe_encode(docs.select("doc_id", "text"), default_vocab())
    return out.select("row.doc_id", "n_tokens", F.sha2("ids_le32", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("line_dedup", repeated_lines), ("near_duplicates", near_duplicates),
          ("decontamination", contamination), ("tokens", tokens)]

#: SQL cannot express the language model, the components and the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


if "pipeline" not in QUERIES:
    register("pipeline", ORACLE_SQL)(run)
