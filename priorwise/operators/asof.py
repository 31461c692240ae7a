"""As-of priors (F3-F11, F16, F18): leak-free history features in one job.

Time rules for a spine row at period (S, r):

* ``season`` scope: facts with the same season and round < r;
* ``career`` scope: facts with season < S;
* ``track`` scope:  facts with season < S, or season = S and round < r.

Recipe (range frames, no per-round loop): the fact rows and the spine rows
are unioned into one frame, a window with a *range* frame ending at -1 sums
the pre-aggregated fact columns of strictly earlier periods, and the spine
rows are kept. Same-period peers (and the row's own result) are excluded by
the range frame. For entity keys the spine rows travel through the window, so no join
back is needed; each call costs one shuffle keyed by the entity key. Keys that many rows of
a period share go through ``group_prior_stats``.

Plan-shape rules kept here:

1. facts are pre-aggregated to (key, period) before the window (partial
   aggregation happens map side; a hot key's facts collapse to one row per period);
2. every window is partitioned by an entity key, or holds grid rows only, never ``over()``;
3. medians are exact over counts of values: a period sends each distinct value once with its count, and
   the counts of the earlier periods are merged and walked to the middle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEASON = "season"
ROUND = "round"
_SPINE = "__spine"
_KINDS = {"count", "rows", "sum", "avg", "min", "max", "median"}


@dataclass(frozen=True)
class Agg:
    """One output column: ``kind`` of ``measure`` over the frame.

    kind: count (non-null values, 0 when none), rows (fact rows, 0 when none),
    sum, avg, min, max, median (null when no values).
    """

    out: str
    kind: str
    measure: str | None = None
    cast: str | None = None


def period_key(season: Column | str = SEASON, round_: Column | str = ROUND) -> Column:
    """Single orderable period number (season, round) -> season * 1000 + round."""
    s = F.col(season) if isinstance(season, str) else season
    r = F.col(round_) if isinstance(round_, str) else round_
    return (s.cast("bigint") * 1000 + r.cast("bigint"))


def _frame(keys: Sequence[str], scope: str):
    if scope == "season":
        return (Window.partitionBy(*keys, SEASON).orderBy(F.col(ROUND))
                .rangeBetween(Window.unboundedPreceding, -1))
    if scope == "track":
        return (Window.partitionBy(*keys).orderBy(F.col("__period"))
                .rangeBetween(Window.unboundedPreceding, -1))
    if scope == "career":
        return (Window.partitionBy(*keys).orderBy(F.col(SEASON))
                .rangeBetween(Window.unboundedPreceding, -1))
    raise ValueError(f"unknown scope {scope!r}")


def middle_value(counts: Column) -> Column:
    """Exact median of values given as an array of (value, count); the same value may come several times. Null if empty."""
    n = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x["__rows"])
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)  # places of the two middle values, from 0

    def walk(state: Column, x: Column) -> Column:
        seen, here = state["seen"], state["seen"] + x["__rows"]

        def take(place: Column, name: str) -> Column:
            return F.when((place >= seen) & (place < here), x["__v"]).otherwise(state[name]).alias(name)

        return F.struct(here.alias("seen"), take(low, "a"), take(high, "b"))

    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), none.alias("a"), none.alias("b"))
    return F.aggregate(F.array_sort(counts), start, walk, lambda s: (s["a"] + s["b"]) / 2)


def prior_stats(spine: DataFrame, facts: DataFrame | Sequence[DataFrame], keys: Sequence[str],
                aggs: Sequence[Agg], scope: str = "season") -> DataFrame:
    """Attach as-of aggregates of ``facts`` to every ``spine`` row.

    ``spine`` needs ``keys``, season and round; ``facts`` needs ``keys``,
    season, round and the measure columns named in ``aggs`` (several fact
    frames are unioned by name). Rows whose key is null never match.
    Returns ``spine`` with one new column per ``Agg``.
    """
    for a in aggs:
        if a.kind not in _KINDS:
            raise ValueError(f"unknown aggregate kind {a.kind!r}")
    keys = list(keys)
    frames = [facts] if isinstance(facts, DataFrame) else list(facts)
    measures = sorted({a.measure for a in aggs if a.measure is not None})
    fact_cols = keys + [SEASON, ROUND]
    f_all = None
    for f in frames:
        cols = [F.col(c) for c in fact_cols]
        cols += [(F.col(m) if m in f.columns else F.lit(None)).cast("double").alias(m) for m in measures]
        sel = f.select(*cols)
        f_all = sel if f_all is None else f_all.unionByName(sel)
    for k in keys:
        f_all = f_all.where(F.col(k).isNotNull())

    need_median = any(a.kind == "median" for a in aggs)
    middle = {a.measure for a in aggs if a.kind == "median"}
    if len(middle) > 1:
        raise ValueError("one call takes the median of one measure")

    # 1. pre-aggregate facts to one row per (key, period) -- or (key, season) for career
    grain = keys + ([SEASON] if scope == "career" else [SEASON, ROUND])
    parts = [F.count(F.lit(1)).alias("__rows")]
    for i, m in enumerate(measures):
        parts += [F.count(m).alias(f"__n_{i}"), F.sum(m).alias(f"__s_{i}"),
                  F.min(m).alias(f"__lo_{i}"), F.max(m).alias(f"__hi_{i}")]
    if need_median:  # by distinct value first, then by period with the values' counts
        value = middle.pop()
        by_value = f_all.withColumn("__v", F.col(value)).groupBy(*grain, "__v").agg(*parts)
        again = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max}
        parts = [F.sum("__rows").alias("__rows"), F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__v", "__rows"))).alias("__counts")]
        parts += [fold(f"__{k}_{i}").alias(f"__{k}_{i}") for i in range(len(measures)) for k, fold in again.items()]
        pre = by_value.groupBy(*grain).agg(*parts)
    else:
        pre = f_all.groupBy(*grain).agg(*parts)
    if scope == "career":
        pre = pre.withColumn(ROUND, F.lit(None).cast("int"))

    # 2. union with the spine rows, which carry all their own columns
    sp = spine.withColumn(_SPINE, F.lit(True))
    pre = pre.withColumn(_SPINE, F.lit(False))
    u = sp.unionByName(pre, allowMissingColumns=True)
    if scope == "track":
        u = u.withColumn("__period", period_key())
    w = _frame(keys, scope)

    # 3. window sums over strictly earlier periods, keep spine rows
    idx = {m: i for i, m in enumerate(measures)}
    new_cols = {}
    for a in aggs:
        if a.kind == "rows":
            c = F.coalesce(F.sum("__rows").over(w), F.lit(0)).cast("bigint")
        else:
            i = idx[a.measure]
            n = F.sum(f"__n_{i}").over(w)
            if a.kind == "count":
                c = F.coalesce(n, F.lit(0)).cast("bigint")
            elif a.kind == "sum":
                c = F.sum(f"__s_{i}").over(w)
            elif a.kind == "avg":
                c = F.sum(f"__s_{i}").over(w) / F.when(n > 0, n)
            elif a.kind == "min":
                c = F.min(f"__lo_{i}").over(w)
            elif a.kind == "max":
                c = F.max(f"__hi_{i}").over(w)
            else:  # median
                c = middle_value(F.flatten(F.collect_list("__counts").over(w)))
        if a.cast:
            c = c.cast(a.cast)
        new_cols[a.out] = c
    out = u.withColumns(new_cols).where(F.col(_SPINE))
    keep = set(spine.columns) | set(new_cols)
    drop = [c for c in out.columns if c.startswith("__") and c not in keep]
    return out.drop(*drop)


def group_prior_stats(spine: DataFrame, facts: DataFrame | Sequence[DataFrame], keys: Sequence[str],
                      aggs: Sequence[Agg], scope: str = "season", base: DataFrame | None = None) -> DataFrame:
    """``prior_stats`` for keys that many spine rows of a period share (a group, a group at a place).

    The priors are computed on the distinct (key, period) grid, where a hot key has one row a period, and
    joined back by equality, so the spine rows of a hot key never meet in one window task and a
    skewed join can be split. ``base``: a frame with the same keys and periods to take the grid from, where
    ``spine`` already carries a long lineage (it would be computed twice).
    """
    at = [*keys, SEASON, ROUND]
    grid = (base if base is not None else spine).select(*at).where(F.col(keys[-1]).isNotNull()).distinct()
    priors = prior_stats(grid, facts, keys, aggs, scope)
    out = spine.join(priors, at, "left")
    zero = {a.out: F.coalesce(F.col(a.out), F.lit(0).cast("bigint")) for a in aggs if a.kind in ("count", "rows")}
    return out.withColumns(zero)


def leave_one_out_delta(spine: DataFrame, facts: DataFrame, group: str, entity: str,
                        measure: str, out: str, base: DataFrame | None = None) -> DataFrame:
    """entity's season-prior mean within its group minus the mean of the
    other entities' season-prior means in that group (B2).

    Each (group, entity) pair's cumulative mean is carried forward to every
    round of the season in which the group appears on the spine, so an entity
    without a row in a round still counts as a teammate later. Null when the
    pair has no history or the entity is alone; null means are ignored.
    """
    pairs = facts.where(F.col(group).isNotNull() & F.col(entity).isNotNull()) \
        .select(group, entity, SEASON).distinct()
    rounds = (base if base is not None else spine).select(group, SEASON, ROUND).distinct()
    # grid = pairs of the season x rounds where the group is on the spine
    grid = pairs.join(rounds, [group, SEASON])
    means = prior_stats(grid, facts, [group, entity],
                        [Agg("__m", "avg", measure), Agg("__k", "count", measure)], scope="season")
    means = means.where(F.col("__k") > 0).drop("__k")
    tot = means.groupBy(group, SEASON, ROUND).agg(
        F.sum("__m").alias("__tot"), F.count("__m").alias("__cnt"))
    joined = (spine
              .join(means, [group, entity, SEASON, ROUND], "left")
              .join(tot, [group, SEASON, ROUND], "left"))
    delta = F.col("__m") - (F.col("__tot") - F.col("__m")) / F.when(F.col("__cnt") > 1, F.col("__cnt") - 1)
    return joined.withColumn(out, delta).drop("__m", "__tot", "__cnt")
