"""Exact dedup over an extendible-hash index kept on shared files.

Method
------
* Every text is normalised (each run of ``[\\x20\\x09-\\x0D]`` is one space) and hashed to 64 bits.
* The *directory* maps the leading bits of the hash to buckets. It starts with one bucket;
  a bucket holding more than ``bucket_capacity`` distinct hashes splits in two by its next bit,
  and the directory doubles whenever a bucket's depth passes the directory's. It has
  at most ``2 ** max_depth`` cells; buckets that are full at that depth just hold more.
* Each bucket is a key range with one *owner task*. Equal hashes are told apart by comparing the
  normalised bytes (they are grouping keys); texts that differ under one hash form a chain
  (``chain`` 0, 1, ...). The owner writes its entries as a file ``bucket=<n>`` of the shared folder.
* Every row then probes the index with its key and digest.

Copies are folded before the shuffle (partial aggregation), so a text that a third of the rows
share reaches its owner as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorwise.llm.common import stage, table
from priorwise.llm.registry import register
from priorwise.session import scratch_path


def normalise(text: Column) -> Column:
    """One space for each run of white space; null is empty. Lone spaces need no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def build_directory(counts: dict[int, int], bits: int, capacity: int) -> tuple[int, list[int]]:
    """Directory of an extendible hash: (global depth, bucket of each cell).

    ``counts`` has the number of entries for each value of the leading ``bits`` bits.
    """
    load = [0]
    for cell in range(2 ** bits):
        load.append(load[-1] + counts.get(cell, 0))
    depth, buckets, pending = 0, [], [(0, 0)]  # a bucket is (its depth, its leading bits)
    while pending:
        local, prefix = pending.pop()
        width = bits - local
        if load[(prefix + 1) << width] - load[prefix << width] > capacity and local < bits:
            depth = max(depth, local + 1)
            pending += [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
        else:
            buckets.append((prefix << width, local))
    cells = []
    for bucket, (_, local) in enumerate(sorted(buckets)):
        cells += [bucket] * 2 ** (depth - local)
    return depth, cells


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bucket_capacity: int = 2048, max_depth: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, chain.

    Defined results: a null text counts as empty; a null id is never smaller than another
    (``keep_id`` is null only if the whole group's ids are); rows that repeat the smallest id of
    their group are all kept, as the id names one document; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), normalise(F.col(f"`{text_col}`")).alias("norm"))
    keyed = base.select("id", "norm", F.xxhash64("norm").alias("h"))

    keys = stage(keyed.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("digest")), "xdedup-keys")
    cell = F.shiftrightunsigned("h", 64 - max_depth)
    counts = keys.select("h").distinct().groupBy(cell.alias("cell")).count()
    depth, cells = build_directory({r["cell"]: r["count"] for r in counts.collect()}, max_depth, bucket_capacity)
    directory = spark.createDataFrame(list(enumerate(cells)), "cell long, bucket int")
    # shifting by 64 would leave the hash as it is: depth 0 has the one cell 0
    at = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")

    # distinct texts of each hash: the grouping compares bytes
    entries = keyed.groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")) \
        .select("h", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size", at.alias("cell"))
    owned = entries.join(F.broadcast(directory), "cell").drop("cell")  # at most 2 ** max_depth rows
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("digest")) - 1
    path = scratch_path(spark, "xdedup-index")
    owned.repartition("bucket").withColumn("chain", chain).write.partitionBy("bucket").parquet(path)
    index = spark.read.schema("h long, digest binary, keep_id " + keys.schema["id"].dataType.simpleString()
                              + ", group_size long, chain int, bucket int").parquet(path)

    probe = keys.join(index.select("h", "digest", "keep_id", "group_size", "chain"), ["h", "digest"])
    return probe.select(F.col("id").alias(id_col), "keep_id", "group_size",
                        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"), "chain")


SQL = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


@register("op9_exact_dedup", SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("chain")
