"""Whitening of integer vectors: centred covariance summed in tasks, leading eigenpairs, broadcast projection.

Method
------
1. The fit list is each distinct vector once, written to the shared folder. Copies are folded before the shuffle,
   so a vector that a third of all rows share is one row a task.
2. Its size n and sums S are exact integers. Each task centres its vectors, (n x - S) / n with the integer
   difference taken first, and sums its outer products; the tasks' matrices are added up block by block
   of rows in Spark, so the driver gets one matrix of ``dims ** 2`` numbers (``max_dims`` bounds it).
3. On that matrix: Householder tridiagonalisation, Sturm-count bisection for the leading eigenvalues, inverse
   iteration with reorthogonalisation within clusters (``eigen.py``).
4. The projection, ``dims x components`` numbers, goes to the tasks; one pass over the fit list measures the
   whitened covariance, another scores all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm.common import bounded_batches, stage, table
from priorwise.llm.eigen import leading_pairs
from priorwise.llm.registry import register

_SAFE = 2 ** 62
_BLOCK = 64  # rows of a matrix that are added up together


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow batch as rows."""
    found = column.flatten().to_numpy(zero_copy_only=False)
    if len(found) != len(column) * dims:
        raise ValueError(f"vectors of other lengths than {dims}")
    return found.reshape(len(column), dims)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: 64-bit integers where they hold it, else Python's."""
    if n * _most(x) < _SAFE and max(map(abs, sums), default=0) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(shifted: np.ndarray) -> list[int]:
    """Sum of squares of each row, exactly."""
    top = max((abs(int(v)) for v in (shifted.max(initial=0), shifted.min(initial=0))), default=0)
    if shifted.dtype != object and top * top * shifted.shape[1] < _SAFE:
        return (shifted * shifted).sum(axis=1).tolist()
    wide = shifted.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def _decimals(values: list[int]) -> pa.Array:
    """Integers of up to 38 digits; null beyond."""
    return pa.array([Decimal(v) if abs(v) < 10 ** 38 else None for v in values], pa.decimal128(38, 0))


def _exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows of ``fit`` and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for b in batches:
            x = _matrix(b.column(0), dims)
            wide = x if len(x) * _most(x) < _SAFE else x.astype(object)
            n, sums = n + len(x), [s + int(v) for s, v in zip(sums, wide.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), _decimals([*sums, n])], ["pos", "value"])

    totals = {r["pos"]: int(r["value"]) for r in fit.mapInArrow(run, "pos int, value decimal(38,0)")
              .groupBy("pos").agg(F.sum("value").alias("value")).collect()}  # dims + 1 rows
    return totals.get(dims, 0), [totals.get(i, 0) for i in range(dims)]


def _summed(fit: DataFrame, rows: int, columns: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over the batches of ``fit`` of the matrices that ``part`` makes of them; tasks' sums meet block by block."""
    blocks = -(-rows // _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for b in batches:
            total += part(b)
        packed = [total[i * _BLOCK:(i + 1) * _BLOCK].tobytes() for i in range(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(packed, pa.binary())], ["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1)):
                found = np.frombuffer(packed.as_buffer())
                totals[block] = totals[block] + found if block in totals else found
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())],
                                         ["block", "part"])

    schema = "block int, part binary"
    found = fit.mapInArrow(run, schema).repartition(blocks, "block").mapInArrow(add, schema).collect()  # rows x columns numbers
    return np.concatenate([np.frombuffer(r["part"]) for r in sorted(found, key=lambda r: r["block"])]).reshape(rows, columns)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "x", components: int = 16, max_dims: int = 2048,
           least: float = 1e-12) -> DataFrame:
    """For each row and component: the id, component, n, deviation (decimal), whitened, explained, identity_error.

    ``vector_col`` holds arrays of integers without nulls. Components are numbered from 1 by falling eigenvalue of the covariance of
    the distinct vectors.

    Defined results: rows with a null vector have no result; a null id is carried; rows that repeat (ids, vectors or both) all
    come back, with equal numbers for equal vectors; components whose eigenvalue is at most ``least`` of the largest have no scale
    and are left out, so a single distinct vector, vectors of no entries and an empty table give no rows; vectors of different
    lengths, or of over ``max_dims`` entries, are an error. ``n`` and ``deviation`` are exact whatever their size (a deviation of over 38 digits is null).
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<bigint>").alias("x")).where("x IS NOT NULL")
    fit = stage(base.select("x").distinct(), "whitening-fit")
    sizes = [r[0] for r in fit.select(F.size("x")).distinct().limit(2).collect()]
    if len(sizes) > 1 or sizes and sizes[0] > max_dims:
        raise ValueError(f"vectors need one length, of at most {max_dims} entries")
    if not sizes or not sizes[0]:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = sizes[0]
    n, sums = _exact_sums(fit, dims)

    def centred(x: np.ndarray) -> np.ndarray:
        return _shifted(x, n, sums).astype(float) / n

    def products(b: pa.RecordBatch) -> np.ndarray:
        c = centred(_matrix(b.column(0), dims))
        return c.T @ c

    covariance = _summed(fit, dims, dims, products) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading_pairs(covariance, components)
    keep = (values > 0) & (values > least * values[0])
    values, axes = values[keep], axes[:, keep]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    projection = spark.sparkContext.broadcast(axes / np.sqrt(values))
    explained = values / np.trace(covariance)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        w = centred(_matrix(b.column(0), dims)) @ projection.value
        return np.vstack([w.T @ w, w.sum(axis=0)])

    seen = _summed(fit, k + 1, k, moments) / n
    error = float(np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shifted = _shifted(_matrix(b.column(1), dims), n, sums)
            w = (shifted.astype(float) / n) @ projection.value
            each = np.repeat(np.arange(len(w)), k)
            rows = len(each)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                 pa.array(np.full(rows, n, np.int64)), _decimals(_squares(shifted)).take(pa.array(each)),
                 pa.array(w.ravel()), pa.array(np.tile(explained, len(w))), pa.array(np.full(rows, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return base.mapInArrow(project, schema).withColumnRenamed("id", id_col)


def lattice(vector: Column, steps: int = 64, offset: int = 1_000_000) -> Column:
    """Entries as integers, floor(steps * entry) + offset; null for a null vector and one with a null, NaN or infinite entry."""
    double = vector.cast("array<double>")
    sound = F.forall(double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(sound, F.transform(double, lambda c: F.floor(c * steps) + F.lit(offset).cast("long")))


@register("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every sound embedding. A deviation of over 19 digits is null here."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", lattice(F.col("embedding")).alias("x"))
    return whiten(rows).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
