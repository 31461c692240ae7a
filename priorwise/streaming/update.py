"""Incremental update loop on Structured Streaming.

New result rows land as files in an incoming folder. A file stream with an
``availableNow`` trigger hands each micro-batch to ``foreachBatch``, which
upserts the touched partitions: batch rows plus the existing rows of those
partitions, latest version wins per key, written with dynamic partition
overwrite. The merged rows are staged first (a job cannot overwrite the
files it reads). Checkpoint and staging folders belong to the table
(``<table>_checkpoint``, ``<table>_staging`` unless given), so a later run with the same
table resumes with the files that are new, and replaying a batch gives the same table
(idempotent). Among rows of a key with equal versions the one of the incoming batch wins over the stored
one, then the largest by value: the result does not depend on file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from priorwise.sources.tables import _exists


def upsert_partitions(batch: DataFrame, table_root: str, keys: Sequence[str], partition_cols: Sequence[str],
                      version_col: str, staging_root: str) -> None:
    spark = batch.sparkSession
    keys, parts = list(keys), list(partition_cols)
    merged = batch.withColumn("__new", F.lit(1))
    if _exists(spark, table_root):
        touched = batch.select(*parts).distinct()
        # the partitions' values, bounded by the batch, as literals: other folders are neither listed nor read
        values = [F.collect_set(p).alias(p) for p in parts]
        seen = touched.agg(*values).first()
        known = spark.read.parquet(table_root)
        for p in parts:
            known = known.where(F.col(p).isin(list(seen[p])))
        existing = known.join(touched, parts, "left_semi")
        merged = existing.withColumn("__new", F.lit(0)).unionByName(merged, allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in sorted(batch.columns) if c not in (*keys, version_col)]
    w = Window.partitionBy(*keys).orderBy(F.col(version_col).desc(), F.col("__new").desc(), *rest)
    latest = merged.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn", "__new")
    latest.write.mode("overwrite").parquet(staging_root)
    staged = spark.read.parquet(staging_root)
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(*parts).parquet(table_root))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # its rows are in the table now


def stream_update(spark: SparkSession, incoming: str, table_root: str, keys: Sequence[str],
                  partition_cols: Sequence[str], version_col: str = "version",
                  max_files_per_trigger: int = 4, schema: StructType | None = None,
                  checkpoint: str | None = None, staging: str | None = None) -> DataFrame:
    """Run the update stream over everything available now; return the table.

    ``schema`` of the incoming rows: read from the files if not given (they must then exist).
    """
    checkpoint, staging = checkpoint or f"{table_root}_checkpoint", staging or f"{table_root}_staging"
    if schema is None:
        schema = spark.read.option("recursiveFileLookup", "true").parquet(incoming).schema
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", max_files_per_trigger).parquet(incoming))

    def each(batch: DataFrame, epoch: int) -> None:
        upsert_partitions(batch, table_root, keys, partition_cols, version_col,
                          f"{staging}/{epoch}")

    q = (stream.writeStream.foreachBatch(each)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(table_root) if _exists(spark, table_root) else spark.createDataFrame([], schema)
