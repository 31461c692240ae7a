"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorwise.llm.common import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (or smaller) neighbours to the least of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v); comp is the least node of its component.

    Each round is a few joins and map-side folded aggregations, written to the shared folder. A hub with
    many neighbours is folded before the shuffle, and its join is split where it is skewed.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct(), name)
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    now = stage(_stars(_stars(now, True), False), name)
    while not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():  # a root that is no root
        now = stage(_stars(_stars(now, True), False), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")) \
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
