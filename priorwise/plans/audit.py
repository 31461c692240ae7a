"""U4: leak audit. Each prior must equal a brute-force recomputation from
rows strictly before the row's period; the result counts mismatches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorwise.operators.asof import Agg, prior_stats
from priorwise.plans.registry import r6

Q = "qualifying_position"


def leak_audit(spine: DataFrame, facts: DataFrame, entity: str = "driver_id") -> DataFrame:
    """Compare the window priors with a non-equi join (``f.round < s.round``)."""
    keys = ["season", "round", entity]
    sp = spine.select(*keys).distinct()
    f = facts.select(entity, "season", "round", Q)

    win_season = prior_stats(sp, f, [entity], [Agg("w", "avg", Q)], scope="season")
    win_career = prior_stats(sp, f, [entity], [Agg("w", "avg", Q)], scope="career")

    s, x = sp.alias("s"), f.alias("x")
    brute_season = (s.join(x, (F.col(f"s.{entity}") == F.col(f"x.{entity}"))
                           & (F.col("s.season") == F.col("x.season"))
                           & (F.col("x.round") < F.col("s.round")), "left")
                    .groupBy(*[F.col(f"s.{k}").alias(k) for k in keys])
                    .agg(F.avg(f"x.{Q}").alias("b")))
    brute_career = (s.join(x, (F.col(f"s.{entity}") == F.col(f"x.{entity}"))
                           & (F.col("x.season") < F.col("s.season")), "left")
                    .groupBy(*[F.col(f"s.{k}").alias(k) for k in keys])
                    .agg(F.avg(f"x.{Q}").alias("b")))

    def count_bad(win: DataFrame, brute: DataFrame, name: str) -> DataFrame:
        j = win.join(brute, keys, "full_outer")
        bad = ~(r6("w").eqNullSafe(r6("b")))
        return j.agg(F.count(F.lit(1)).alias("checked_rows"),
                     F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("mismatches")) \
            .select(F.lit(name).alias("prior_name"), "checked_rows", "mismatches")

    return count_bad(win_season, brute_season, "season_prior").unionByName(
        count_bad(win_career, brute_career, "career_prior"))
