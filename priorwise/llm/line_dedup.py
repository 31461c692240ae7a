"""Line dedup over levelled sorted runs of line hashes.

Method
------
Documents arrive in batches. For each batch the long lines are hashed (128 bits of the stripped,
lower-cased line) and folded to one row a hash: how many documents hold it, the largest id of these.

* A *run* is a table bucketed and sorted by hash. The batch is merge-anti-joined with every live run:
  what survives was never seen before and becomes the batch's own run on level 0.
  What does not survive is a repeat; its counts are written as the batch's *deltas*.
* *Compaction*: when a level has ``fanout`` runs, they are merged into one run of the next level.
  Runs hold disjoint hashes and share one bucketing, so anti-joins and merges read
  them bucket by bucket without a shuffle. There are at most ``fanout`` runs on each of
  ``log(batches)`` levels.
* At the end the runs plus the deltas give each hash its document count and its owner.
  Only lines met again can reach the threshold of two or more documents, so the rest is never counted twice.

A second pass marks the lines to drop (position by position, the text does not travel with them)
and rebuilds the texts. Everything is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import WS, ascii_lower, stage, table, with_row
from priorwise.llm.registry import register


class LineRuns:
    """Levelled sorted runs: managed tables, bucketed and sorted by line hash ``h``."""

    def __init__(self, spark: SparkSession, fanout: int, buckets: int):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[str]] = []
        self.deltas: list[str] = []
        self.prefix = f"line_run_{uuid.uuid4().hex[:12]}"
        self.made = 0

    def save(self, df: DataFrame, *partition_by: str) -> str:
        """Write ``df`` as a table of one sorted file a bucket."""
        self.made += 1
        name = f"{self.prefix}_{self.made}"
        w = df.write.bucketBy(self.buckets, "h").sortBy("h")
        (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")

    def add(self, batch: DataFrame) -> None:
        """Take in one batch: rows (h, n_docs, owner), one a hash, bucketed as the runs are."""
        fresh = batch
        for run in (r for level in self.levels for r in level):
            fresh = fresh.join(self.spark.table(run).select("h").hint("merge"), "h", "left_anti")
        own = self.save(fresh)
        if self.levels:
            self.deltas.append(self.save(batch.join(self.spark.table(own).select("h").hint("merge"), "h", "left_anti")))
        level = 0
        while own:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(own)
            own = self._compact(level) if len(self.levels[level]) >= self.fanout else None
            level += 1

    def _compact(self, level: int) -> str:
        """Merge the level's runs (disjoint hashes) into one run of the next level."""
        runs, self.levels[level] = self.levels[level], []
        merged = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).select("h", F.col("n_docs").alias("n2"), F.col("owner").alias("o2"))
            merged = merged.join(other.hint("merge"), "h", "full") \
                .select("h", F.coalesce("n_docs", "n2").alias("n_docs"), F.coalesce("owner", "o2").alias("owner"))
        name = self.save(merged)
        for run in runs:
            self.drop(run)
        return name

    def totals(self) -> DataFrame:
        """(h, n_docs, owner) over all batches."""
        runs = [r for level in self.levels for r in level]
        total = self.spark.table(runs[0])
        for run in runs[1:]:
            total = total.unionByName(self.spark.table(run))
        if not self.deltas:
            return total
        again = self.spark.table(self.deltas[0])
        for d in self.deltas[1:]:
            again = again.unionByName(self.spark.table(d))
        again = again.groupBy("h").agg(F.sum("n_docs").alias("n2"), F.max("owner").alias("o2"))
        return total.join(again, "h", "left").select(
            "h", (F.col("n_docs") + F.coalesce("n2", F.lit(0))).alias("n_docs"),
            F.greatest("owner", "o2").alias("owner"))  # greatest skips nulls

    def close(self) -> None:
        for name in [r for level in self.levels for r in level] + self.deltas:
            self.drop(name)


def line_hash(line: Column, min_chars: int) -> Column:
    """Hash of a (lower-cased) line's key, null if the key is shorter than ``min_chars`` code points."""
    key = F.btrim(line, F.lit(WS))
    return F.when(F.char_length(key) >= min_chars, F.md5(key))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """The input rows as ``row`` with kept_text, n_lines and n_dropped.

    A line goes if its key has at least ``min_chars`` code points, at least ``min_docs`` rows hold it,
    and the row's id is not the largest of the ids that hold it.

    Defined results: null and empty texts are one empty line, which stays; every row counts as a
    document, also one that repeats another; rows that share the largest id all keep the line; a null
    id is smaller than any other, and a line held by null ids alone stays in all of them; a short or
    repeated short line always stays; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ident = F.col(f"`{id_col}`")
    hashes = F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: line_hash(line, min_chars))

    # one row for each (batch, hash): the text is read once for all batches
    runs = LineRuns(spark, fanout, buckets)
    arrived = docs.select(ident.alias("id"), F.pmod(F.xxhash64(ident), F.lit(batches)).cast("int").alias("batch"),
                          F.explode(F.array_distinct(hashes)).alias("h")).where("h IS NOT NULL") \
        .groupBy("batch", F.unhex("h").alias("h")).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("owner"))
    batch_table = runs.save(arrived.repartition(buckets, "h"), "batch")
    for b in range(batches):
        runs.add(spark.table(batch_table).where(F.col("batch") == b).select("h", "n_docs", "owner"))
    repeated = stage(runs.totals().where(F.col("n_docs") >= min_docs).select("h", "owner"), "line-repeats")
    runs.drop(batch_table)
    runs.close()

    # positions to drop, for each row of the input by id and text hash
    held = docs.select(ident.alias("id"), F.xxhash64(text).alias("th"), F.posexplode(hashes).alias("pos", "h")) \
        .where("h IS NOT NULL").withColumn("h", F.unhex("h"))
    gone = held.join(repeated, "h").where(~F.col("id").eqNullSafe(F.col("owner"))) \
        .groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))
    rows = with_row(docs, id=ident, text=text, th=F.xxhash64(text))
    joined = rows.join(gone.withColumnsRenamed({"id": "gone_id", "th": "gone_th"}),
                       F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return joined.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
                         F.size(lines).cast("long").alias("n_lines"),
                         F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), g AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id <> g.owner AS gone
  FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@register("op2_line_dedup", SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
