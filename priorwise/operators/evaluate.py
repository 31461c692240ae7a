"""Compare, evaluate and coverage.

All evaluations are grouped aggregations over (season, round); no per-round
loop. Rounds without predictions or without actuals are skipped with
``left_semi`` joins on the round keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwise.functions.exprs import path_key
from priorwise.operators.ranking import ranked
from priorwise.sources.tables import staged

PERIOD = ["season", "round"]
DNF = "DNF"


def actual_position_label(finish: str = "finish_position", dnf: str = "dnf") -> Column:
    """X8: 'DNF' when dnf = 1 or the finish is unknown, else the finish as text."""
    return (F.when((F.coalesce(F.col(dnf), F.lit(0)) == 1) | F.col(finish).isNull(), F.lit(DNF))
            .otherwise(F.col(finish).cast("bigint").cast("string")))


def eval_top(pred: DataFrame, actual: DataFrame, entity: str = "driver_id",
             actual_col: str = "finish_position", period: Sequence[str] = PERIOD,
             ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """V4: per round MAE (nulls ignored), exact hits, top-k hits and n (all predicted rows).

    top-k counts the rows predicted in the first k that really ended <= k.
    Rounds lacking actual rows are skipped.
    """
    period = list(period)
    act = actual.select(*period, entity, F.col(actual_col).alias("__actual"))
    m = (pred.join(actual.select(*period).distinct(), period, "left_semi")
         .join(act, period + [entity], "left"))
    err = F.abs(F.col("predicted_position") - F.col("__actual"))
    aggs = [F.avg(err).alias("mae"),
            F.sum(F.when(F.col("predicted_position") == F.col("__actual"), 1).otherwise(0))
             .cast("bigint").alias("exact")]
    for k in ks:
        aggs.append(F.sum(F.when((F.col("predicted_position") <= k) & (F.col("__actual") <= k), 1)
                          .otherwise(0)).cast("bigint").alias(f"top{k}"))
    aggs.append(F.count(F.lit(1)).alias("n"))
    return m.groupBy(*period).agg(*aggs)


def actual_hits(entities: DataFrame, counts: DataFrame, actual: DataFrame, entity: str = "driver_id",
                actual_col: str = "qualifying_position", period: Sequence[str] = PERIOD,
                with_dnf: bool = False, missing_is_dnf: bool = False) -> DataFrame:
    """Each predicted entity with its actual position and the draws that put it there.

    An actual position counts if it lies in 1..n of the group's n predicted entities, or is 'DNF'; a position
    that was never drawn has 0 draws, so sparse counts say the same as a dense matrix would.
    ``with_dnf``: positions are text (X8). ``missing_is_dnf``: an entity without an actual row counts as DNF
    (the label is made after the left join); otherwise it has no actual.
    """
    period = list(period)
    members = entities.select(*period, entity).distinct()
    sizes = members.groupBy(*period).agg(F.count(F.lit(1)).alias("__n"))
    cols = [actual_col, *(["dnf"] if with_dnf else [])]
    act = actual.select(*period, entity, *cols, F.lit(1).alias("__there"))
    m = members.join(sizes, period).join(act, period + [entity], "left")
    number = F.col(actual_col).cast("bigint")
    inside = number.between(1, F.col("__n"))
    if with_dnf:
        label = actual_position_label(actual_col)
        there = F.lit(True) if missing_is_dnf else F.col("__there").isNotNull()
        position = F.when(there & ((label == DNF) | inside), label)
    else:
        position = F.when(inside, number)
    m = m.select(*period, entity, position.alias("position"))
    return m.join(counts.select(*period, entity, "position", "draws"), period + [entity, "position"], "left") \
        .select(*period, entity, F.col("position").alias("actual_position"),
                F.when(F.col("position").isNotNull(), F.coalesce(F.col("draws"), F.lit(0))).alias("draws"))


def mean_probability(hits: DataFrame, samples: int, period: Sequence[str] = PERIOD) -> DataFrame:
    """Per group: entities with an actual position, and the mean probability put on it (from whole counts)."""
    n = F.count("actual_position")
    return hits.groupBy(*period).agg(
        n.alias("hits"), (F.sum("draws") / F.when(n > 0, n * F.lit(float(samples)))).alias("avg_p_actual"))


def eval_dist(entities: DataFrame, counts: DataFrame, actual: DataFrame, samples: int, entity: str = "driver_id",
              actual_col: str = "qualifying_position", period: Sequence[str] = PERIOD,
              with_dnf: bool = False) -> DataFrame:
    """V5: per round mean probability assigned to the actual position; rounds without actual rows are skipped.

    ``with_dnf``: the actual label is computed on the actuals *before* joining (X8),
    so a missing actual never counts.
    """
    played = entities.join(actual.select(*period).distinct(), list(period), "left_semi")
    hits = actual_hits(played, counts, actual, entity, actual_col, period, with_dnf)
    return mean_probability(hits, samples, period).select(*period, "avg_p_actual")


def eval_range_summary(top_rounds: DataFrame, dist_rounds: DataFrame | None = None,
                       by: Sequence[str] = ("season",), ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """V6: summary over the evaluated rounds of a range.

    MAE = mean of round MAEs; exact rate = sum(exact) / sum(n);
    top-k rate = sum(top-k) / (rounds * k); avg P = mean of the round values.
    """
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("rounds"), F.avg("mae").alias("mae"),
            (F.sum("exact") / F.when(F.sum("n") > 0, F.sum("n"))).alias("exact_rate")]
    for k in ks:
        aggs.append((F.sum(f"top{k}") / (F.count(F.lit(1)) * k)).alias(f"top{k}_rate"))
    out = top_rounds.groupBy(*by).agg(*aggs)
    if dist_rounds is not None:
        d = dist_rounds.groupBy(*by).agg(F.avg("avg_p_actual").alias("avg_p_actual"))
        out = out.join(d, by, "left")
    return out


def compare_top(pred: DataFrame, actual: DataFrame, entity: str = "driver_id",
                actual_col: str = "qualifying_position", sentinel: str = "NO_QUALI_RESULT",
                period: Sequence[str] = PERIOD) -> DataFrame:
    """V1 detail: prediction left-joined to the actual; abs error; X9 sentinel text."""
    period = list(period)
    act = actual.select(*period, entity, F.col(actual_col).alias("actual_position"))
    m = pred.join(act, period + [entity], "left")
    return m.withColumns({
        "abs_error": F.abs(F.col("predicted_position") - F.col("actual_position")),
        "actual_text": F.coalesce(F.col("actual_position").cast("string"), F.lit(sentinel)),
    })


def compare_top_summary(detail: DataFrame, period: Sequence[str] = PERIOD) -> DataFrame:
    """V1 summary: MAE over valid rows, exact hits over valid, missing count."""
    valid = F.col("actual_position").isNotNull()
    return detail.groupBy(*period).agg(
        F.avg(F.when(valid, F.col("abs_error"))).alias("mae"),
        F.sum(F.when(valid & (F.col("abs_error") == 0), 1).otherwise(0)).cast("bigint").alias("exact"),
        F.count(F.when(valid, 1)).alias("valid"),
        F.count(F.when(~valid, 1)).alias("missing"),
    )


def compare_dist(entities: DataFrame, counts: DataFrame, actual: DataFrame, samples: int,
                 entity: str = "driver_id", actual_col: str = "qualifying_position",
                 period: Sequence[str] = PERIOD, with_dnf: bool = False) -> tuple[DataFrame, DataFrame]:
    """V2 / V3: (detail, summary). The detail has each entity with an actual position and its probability, the
    summary the number of these and the mean. V3 (``with_dnf``) labels after a left join, so an entity
    without an actual counts as DNF."""
    hits = actual_hits(entities, counts, actual, entity, actual_col, period, with_dnf, missing_is_dnf=with_dnf)
    hits = hits.where(F.col("actual_position").isNotNull())
    detail = hits.withColumn("probability", F.col("draws") / F.lit(float(samples)))
    return detail, mean_probability(hits, samples, period)


def coverage(calendar: DataFrame, results: DataFrame) -> DataFrame:
    """V7: per season distinct calendar rounds vs rounds with results and a complete flag."""
    cal = calendar.groupBy("season").agg(F.count_distinct("round").alias("calendar_rounds"))
    res = results.groupBy("season").agg(F.count_distinct("round").alias("result_rounds"))
    out = cal.join(res, "season", "full_outer").select(
        "season",
        F.coalesce("calendar_rounds", F.lit(0)).alias("calendar_rounds"),
        F.coalesce("result_rounds", F.lit(0)).alias("result_rounds"))
    return out.withColumn("complete", ((F.col("calendar_rounds") > 0)
                                       & (F.col("result_rounds") >= F.col("calendar_rounds"))).cast("int"))


def coverage_summary(cov: DataFrame) -> DataFrame:
    """V7 summary: trained range (complete seasons) and progress of the latest season."""
    latest = cov.agg(F.max("season").alias("season"))
    prog = cov.join(latest, "season").select(
        F.col("season").alias("current_season"),
        F.col("result_rounds").alias("current_done"),
        F.col("calendar_rounds").alias("current_total"))
    done = cov.where(F.col("complete") == 1).agg(
        F.min("season").alias("trained_from"), F.max("season").alias("trained_to"),
        F.count(F.lit(1)).alias("complete_seasons"))
    return done.crossJoin(prog)


def latest_round(per_dataset: Sequence[DataFrame]) -> DataFrame:
    """V8: latest (season, round) available across datasets; round 1 of an unknown season when there is none.

    Each input carries (season, round); the latest season overall is taken
    and the highest round seen in it in any dataset.
    """
    u = None
    for d in per_dataset:
        part = d.select("season", "round").groupBy("season").agg(F.max("round").alias("round"))
        u = part if u is None else u.unionByName(part)
    best = u.agg(F.max(F.struct("season", "round")).alias("b"))  # always one row
    return best.select("b.season", F.coalesce("b.round", F.lit(1)).alias("round"))


def latest_stored_round(listings: Sequence[DataFrame]) -> DataFrame:
    """V8 from storage: like ``latest_round`` for frames of partition paths (X10 reads season and round off them)."""
    return latest_round([p.select(path_key("path", "season").alias("season"), path_key("path", "round").alias("round"))
                         .where(F.col("season").isNotNull() & F.col("round").isNotNull()) for p in listings])


def weekend_info(weekends: DataFrame, season: int, round_: int) -> DataFrame:
    """V9: one weekend with its sprint flag."""
    return (weekends.where((F.col("season") == season) & (F.col("round") == round_))
            .withColumn("has_sprint", F.col("sprint_date").isNotNull().cast("int")))


def availability_matrix(datasets: dict[str, DataFrame]) -> DataFrame:
    """Per (season, round), 1/0 per dataset name."""
    u = None
    for name, d in datasets.items():
        part = d.select("season", "round").distinct().withColumn("dataset", F.lit(name))
        u = part if u is None else u.unionByName(part)
    names = sorted(datasets)
    return (u.groupBy("season", "round").pivot("dataset", names).agg(F.count(F.lit(1)))
            .fillna(0, subset=names))


def rank_corr(pred: DataFrame, actual: DataFrame, entity: str = "driver_id",
              actual_col: str = "finish_position", period: Sequence[str] = PERIOD) -> DataFrame:
    """V11 Spearman: Pearson correlation of ranks (average rank on ties) per round."""
    period = list(period)
    m = pred.join(actual.select(*period, entity, F.col(actual_col).alias("__a")), period + [entity])
    m = m.where(F.col("__a").isNotNull() & F.col("score").isNotNull())

    m = staged(m.select(*period, "score", "__a"), "rank-corr")
    m = ranked(ranked(m, period, "score", "__ra", "average"), period, "__a", "__rb", "average")
    # rounds where either ranking is constant have no correlation (NULL); they are
    # left out of corr() so ANSI mode never divides by zero
    st = m.groupBy(*period).agg(F.count(F.lit(1)).alias("n"),
                                (F.min("__ra") < F.max("__ra")).alias("__va"),
                                (F.min("__rb") < F.max("__rb")).alias("__vb"))
    ok = st.where(F.col("__va") & F.col("__vb")).select(*period)
    c = m.join(ok, period, "left_semi").groupBy(*period).agg(F.corr("__ra", "__rb").alias("spearman"))
    return st.join(c, period, "left").select(*period, "spearman", "n")


def brier(counts: DataFrame, actual: DataFrame, samples: int, out: str, drawn: Column, happened: Column,
          entity: str = "driver_id", period: Sequence[str] = PERIOD) -> DataFrame:
    """V11 Brier score of an event per round: ``drawn`` says which drawn positions are the event,
    ``happened`` whether it came true. Computed on whole draw counts, so the sum is exact."""
    period = list(period)
    p = counts.groupBy(*period, entity).agg(F.sum(F.when(drawn, F.col("draws")).otherwise(0)).alias("__c"))
    y = actual.select(*period, entity, F.when(happened, F.lit(samples)).otherwise(0).alias("__y"))
    d = F.col("__c") - F.coalesce(F.col("__y"), F.lit(0))
    return p.join(y, period + [entity], "left").groupBy(*period).agg(
        (F.sum(d * d) / (F.count(F.lit(1)) * F.lit(float(samples) ** 2))).alias(out))


def brier_topk(counts: DataFrame, actual: DataFrame, k: int, samples: int, entity: str = "driver_id",
               actual_col: str = "finish_position", period: Sequence[str] = PERIOD) -> DataFrame:
    """V11 Brier score of P(position <= k) per round."""
    return brier(counts, actual, samples, f"brier_top{k}", F.col("position").try_cast("bigint") <= k,
                 F.col(actual_col) <= k, entity, period)


def brier_dnf(counts: DataFrame, actual: DataFrame, samples: int, entity: str = "driver_id",
              period: Sequence[str] = PERIOD) -> DataFrame:
    """V11 Brier score of the withdrawal probability per round."""
    return brier(counts, actual, samples, "brier_dnf", F.col("position") == DNF, F.col("dnf") == 1, entity, period)


def log_loss(dist: DataFrame, actual: DataFrame, entity: str = "driver_id",
             actual_col: str = "finish_position", period: Sequence[str] = PERIOD,
             eps: float = 1e-15, with_dnf: bool = False) -> DataFrame:
    """V11 log loss: mean of -ln(max(P(actual), eps)) over entities with an actual."""
    period = list(period)
    if with_dnf:
        act = actual.select(*period, entity, actual_position_label(actual_col).alias("__a"))
        pos = F.col("position").cast("string")
    else:
        act = actual.where(F.col(actual_col).isNotNull()) \
            .select(*period, entity, F.col(actual_col).cast("bigint").alias("__a"))
        pos = F.col("position").cast("bigint")
    d = dist.withColumn("__pos", pos).join(act, period + [entity])
    pa = d.groupBy(*period, entity).agg(
        F.sum(F.when(F.col("__pos") == F.col("__a"), F.col("probability")).otherwise(0.0)).alias("__p"))
    return pa.groupBy(*period).agg(
        F.avg(-F.log(F.greatest(F.col("__p"), F.lit(eps)))).alias("log_loss"),
        F.count(F.lit(1)).alias("n"))
