"""Table scans and sinks.

All scans go through ``spark.read.parquet`` so Catalyst prunes columns,
pushes predicates into the Parquet reader and prunes hive partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from priorwise.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's input tables (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation for many readers, and it survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partition_paths(spark: SparkSession, root: str, keys: Sequence[str] = ("season", "round")) -> DataFrame:
    """Folders of a partitioned table down to the ``keys``, one row ``path`` each, from the listing alone: no file is opened.

    Bounded by the partitions there are. A table that does not exist has none.
    """
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path("/".join([root.rstrip("/"), *[f"{k}=*" for k in keys]]))
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().toString() for f in (fs.globStatus(pattern) or [])]
    return spark.createDataFrame([(p,) for p in found], "path string")


def scan_partitioned(spark: SparkSession, root: str, season: int | None = None,
                     round_: int | None = None, season_max: int | None = None,
                     schema: StructType | None = None) -> DataFrame:
    """S3: hive-partitioned table scan with a season / season+round / season<=S predicate.

    The predicates are plain column filters: Spark turns the one on the
    ``season`` partition column into partition pruning and the one on
    ``round`` into a Parquet row-group filter.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(root)
    cond = F.lit(True)
    if season is not None:
        cond = cond & (F.col("season") == F.lit(season))
    if round_ is not None:
        cond = cond & (F.col("round") == F.lit(round_))
    if season_max is not None:
        cond = cond & (F.col("season") <= F.lit(season_max))
    return df.where(cond)


def scan_optional(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """A missing table reads as an empty frame of the given schema."""
    if not _exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


def write_partitioned(df: DataFrame, root: str, partition_cols: Sequence[str] = ("season",),
                      overwrite: bool = True) -> DataFrame:
    """Season-partitioned sink.

    ``overwrite=True`` rewrites only the partitions present in ``df``
    (dynamic partition overwrite). ``overwrite=False`` keeps every existing
    partition untouched and appends only partitions that are not there yet
    (a ``left_anti`` on the partition keys).
    Returns the rows that were written.
    """
    spark = df.sparkSession
    cols = list(partition_cols)
    if overwrite or not _exists(spark, root):
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(*cols).parquet(root))
        return df
    existing = spark.read.parquet(root).select(*cols).distinct()
    new_rows = df.join(existing, on=cols, how="left_anti")
    new_rows.write.mode("append").partitionBy(*cols).parquet(root)
    return new_rows


def union_sessions(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of per-session frames whose schemas differ (missing -> NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def only_missing(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose keys are not produced yet."""
    return incoming.join(existing.select(*keys).distinct(), on=list(keys), how="left_anti")


def preview_topn(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
