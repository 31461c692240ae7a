"""Training frames and Spark ML models.

Data preparation (M1-M5, M8, M9, M11, M13, M14, M19) is plain DataFrame
work and checked exactly against SQL. Models are those of ``pyspark.ml``; the trees
are grown by ``boost``, calibration is fitted on the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, NumericType, StructField, StructType

from priorwise.operators.boost import BoostedTrees

MISSING = "__MISSING__"
KEYS = ["season", "round", "driver_id", "constructor_id"]
APPROX = 2000   # accuracy of the values that enclose a median: ranks are right to one in 2,000
NEAR = 0.0015   # their distance from the middle, three times that


def as_of_filter(season: int, round_: int, start: int, train_end: int) -> F.Column:
    """Rows usable for training as of (season, round): seasons start..min(S, train_end),
    and in season S only rounds before r."""
    last = min(season, train_end)
    c = (F.col("season") >= start) & (F.col("season") <= last)
    return c & ((F.col("season") < season) | (F.col("round") < round_))


def train_frame(features: DataFrame, labels: DataFrame, label_cols: Sequence[str], season: int, round_: int,
                start: int, train_end: int, drop_null: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """M1 / M2: features inner-joined to labels under the as-of cutoff.

    M1 drops rows whose label is NULL; M2 keeps NULL finishes (``drop_null`` empty).
    The cutoff is applied to both sides before the join, so Parquet and
    partition filters reach both scans.
    """
    cond = as_of_filter(season, round_, start, train_end)
    lab = labels.where(cond).select(*keys, *label_cols)
    out = features.where(cond).join(lab, list(keys), "inner")
    for c in drop_null:
        out = out.where(F.col(c).isNotNull())
    return out


def sanitize(df: DataFrame, id_cols: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """M3: non-numeric and listed id columns -> string with '__MISSING__';
    everything else -> double (``try_cast``)."""
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            out.append(F.col(f.name))
        elif f.name in id_cols or not isinstance(f.dataType, NumericType):
            out.append(F.coalesce(F.col(f.name).cast("string"), F.lit(MISSING)).alias(f.name))
        else:
            out.append(F.col(f.name).try_cast("double").alias(f.name))
    return df.select(*out)


def fit_impute(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """M4 fit: one-row frame with, per numeric column, its exact median and
    its non-null count (a column with 0 is dropped, a column with nulls gets
    an indicator).

    ``df`` is read three times: give a stored frame."""
    seen = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(numeric)],
                  *[F.percentile_approx(F.col(c).cast("double"), [0.5 - NEAR, 0.5 + NEAR], APPROX).alias(f"b{i}") for i, c in enumerate(numeric)]).first()
    middle = exact_medians(df, {c: (seen[f"n{i}"], *seen[f"b{i}"]) for i, c in enumerate(numeric) if seen[f"n{i}"]})
    values, fields = [], []
    for i, c in enumerate(numeric):
        values += [middle.get(c), seen[f"n{i}"]]
        fields += [StructField(f"{c}__median", DoubleType()), StructField(f"{c}__nonnull", LongType(), False)]
    return df.sparkSession.createDataFrame([(*values, seen["__rows"])], StructType([*fields, StructField("__rows", LongType(), False)]))


def exact_medians(df: DataFrame, near: dict[str, tuple[int, float, float]]) -> dict[str, float]:
    """Exact median of each column, from its non-null count and two values that should lie on both sides of it.

    The values below the lower one are only counted. Those between the two, a few in a thousand, are grouped by value and counted
    up to the middle. A column whose middle is not between them takes all its values that way."""
    if not near:
        return {}
    value = {c: F.col(c).cast("double") for c in near}
    below = df.agg(*[f.alias(f"{k}{i}") for i, (c, (_, lo, hi)) in enumerate(near.items()) for k, f in (
        ("less", F.sum((value[c] < lo).cast("bigint"))), ("upto", F.sum((value[c] <= hi).cast("bigint"))))]).first()
    places, taken = [], []
    for i, (c, (n, lo, hi)) in enumerate(near.items()):
        low, high, less = (n - 1) // 2, n // 2, below[f"less{i}"]
        met = less <= low and high < below[f"upto{i}"]
        places.append((i, low - less, high - less) if met else (i, low, high))
        within = value[c].between(lo, hi) if met else value[c].isNotNull()
        taken.append(F.when(within, F.struct(F.lit(i).alias("column"), value[c].alias("value"))))
    counts = df.select(F.explode(F.array_compact(F.array(*taken))).alias("v")).groupBy("v.column", "v.value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    at = df.sparkSession.createDataFrame(places, "column int, low long, high long")
    found = counts.withColumn("seen", F.sum("n").over(upto)).join(F.broadcast(at), "column") \
        .where("seen > low and seen - n <= high").groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect()  # one row a column
    names = list(near)
    return {names[r["column"]]: r["a"] if r["a"] == r["b"] else 0.5 * r["a"] + 0.5 * r["b"] for r in found}


def apply_impute(df: DataFrame, stats: dict, numeric: Sequence[str]) -> DataFrame:
    """M4 apply: fill with the fitted median, add ``<col>__missing`` indicators
    for columns that had nulls at fit time, drop all-null columns."""
    rows = stats["__rows"]
    out = df
    for c in numeric:
        nn = stats[f"{c}__nonnull"]
        if nn == 0:
            out = out.drop(c)
            continue
        if nn < rows:
            out = out.withColumn(f"{c}__missing", F.col(c).isNull().cast("double"))
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(float(stats[f"{c}__median"]))))
    return out


def onehot_index(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M5 index table: value -> index by descending frequency then value
    (the StringIndexer 'frequencyDesc' order)."""
    u = None
    for c in cols:
        part = df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("freq")) \
            .withColumn("column", F.lit(c))
        u = part if u is None else u.unionByName(part)
    w = Window.partitionBy("column").orderBy(F.col("freq").desc(), F.col("value"))
    return u.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))


def recency_weight(df: DataFrame, step: float = 0.1) -> DataFrame:
    """M8: 1 + step * (season - min season); the minimum comes from a 1-row
    aggregate joined back (no un-partitioned window)."""
    mn = df.agg(F.min("season").alias("__min_season"))
    return (df.crossJoin(F.broadcast(mn))
            .withColumn("weight", 1.0 + step * (F.col("season") - F.col("__min_season")))
            .drop("__min_season"))


def base_rate_recent(df: DataFrame, label: str = "dnf", seasons: int = 7) -> DataFrame:
    """M9: mean label over the last ``seasons`` seasons of the frame (max-6 .. max)."""
    mx = df.agg(F.max("season").alias("__max"))
    recent = df.crossJoin(F.broadcast(mx)).where(F.col("season") >= F.col("__max") - (seasons - 1))
    return recent.agg(F.avg(F.col(label).cast("double")).alias("base_rate"),
                      F.count(F.lit(1)).alias("rows"), F.min("season").alias("from_season"),
                      F.max("season").alias("to_season"))


def calibration_split(df: DataFrame) -> DataFrame:
    """M11: 'train' for seasons before the last one, 'calibrate' for the last."""
    mx = df.agg(F.max("season").alias("__max"))
    return (df.crossJoin(F.broadcast(mx))
            .withColumn("split", F.when(F.col("season") < F.col("__max"), "train").otherwise("calibrate"))
            .drop("__max"))


def rescale_to_rate(df: DataFrame, base_rate: float | DataFrame, p: str = "p",
                    period: Sequence[str] = ("season", "round"), out: str = "p_rescaled") -> DataFrame:
    """P * base / mean(p) over the scored round, clipped to [0, 1];
    unchanged when the round mean is 0. The mean is a grouped aggregate joined
    back; ``base_rate`` is a number or a 1-row frame with a ``base_rate`` column."""
    m = df.groupBy(*period).agg(F.avg(p).alias("__mean"))
    j = df.join(m, list(period))
    if isinstance(base_rate, DataFrame):
        j = j.crossJoin(F.broadcast(base_rate.select(F.col("base_rate").alias("__base"))))
        base = F.col("__base")
    else:
        base = F.lit(float(base_rate))
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p) * base / F.col("__mean")))
    out_df = j.withColumn(out, F.when(F.col("__mean") > 0, scaled).otherwise(F.col(p)))
    return out_df.drop(*[c for c in ("__mean", "__base") if c in out_df.columns])


def train_cutoff(quali: DataFrame, race: DataFrame, train_end: int) -> DataFrame:
    """target = min(max quali season, max race season, train_end) + 1, round 1."""
    q = quali.agg(F.max("season").alias("q"))
    r = race.agg(F.max("season").alias("r"))
    return q.crossJoin(r).select(
        (F.least(F.col("q"), F.col("r"), F.lit(train_end)) + 1).cast("bigint").alias("target_season"),
        F.lit(1).cast("bigint").alias("target_round"))


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str], model) -> Pipeline:
    """M5 + model: index and one-hot the categoricals (unseen values -> zero
    vector), assemble with the numeric columns, then the trees that ``model`` describes."""
    stages = []
    enc_cols = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                    stringOrderType="frequencyDesc"))
        enc_cols.append(f"{c}__idx")
    if enc_cols:
        stages.append(OneHotEncoder(inputCols=enc_cols, outputCols=[f"{c}__oh" for c in categorical],
                                    handleInvalid="error", dropLast=True))
    stages.append(VectorAssembler(inputCols=list(numeric) + [f"{c}__oh" for c in categorical],
                                  outputCol="features", handleInvalid="keep"))
    stages.append(BoostedTrees(model, list(numeric), [f"{c}__idx" for c in categorical]))
    return Pipeline(stages=stages)


def position_regressor(label: str, trees: int = 500, depth: int = 6, weight: str | None = None,
                       min_instances: int = 1) -> GBTRegressor:
    """M6 / M7: boosted trees (lr 0.05, row and column sampling 0.8, seed 42)."""
    kw = dict(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.05,
              subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42, minInstancesPerNode=min_instances)
    if weight:
        kw["weightCol"] = weight
    return GBTRegressor(**kw)


def event_classifier(label: str, trees: int = 400, depth: int = 5, weight: str | None = None) -> GBTClassifier:
    """Logistic boosted trees for the withdrawal event."""
    kw = dict(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.05,
              subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    if weight:
        kw["weightCol"] = weight
    return GBTClassifier(**kw)


def class_weight(df: DataFrame, label: str, base_rate: float) -> DataFrame:
    """M10 weights: positives weighted (1 - p) / p, times the recency weight when present."""
    w = F.when(F.col(label) == 1, F.lit((1.0 - base_rate) / base_rate)).otherwise(F.lit(1.0))
    if "weight" in df.columns:
        w = w * F.col("weight")
    return df.withColumn("event_weight", w)


def event_probability(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """M15 for classifiers: probability of the positive class."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1])


def calibrate_isotonic(scored: DataFrame, p: str, label: str) -> IsotonicRegression:
    """Isotonic calibration estimator (out-of-range inputs clip to the edge values)."""
    return IsotonicRegression(featuresCol=p, labelCol=label, predictionCol=f"{p}_cal", isotonic=True)


def feature_names(model: PipelineModel, rows: DataFrame) -> list[str]:
    """Name of each slot of the assembled vector: a column, or column=value for a one-hot slot."""
    values = {st.getOutputCol(): (st.getInputCol(), st.labels) for st in model.stages if isinstance(st, StringIndexerModel)}
    column = {}
    for st in model.stages:
        if isinstance(st, OneHotEncoderModel):
            column = dict(zip(st.getOutputCols(), st.getInputCols()))
    attrs = model.transform(rows.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {}
    for a in (x for kind in attrs.values() for x in kind):
        block = next((o for o in column if a["name"].startswith(f"{o}_")), None)
        if block:
            source, labels = values[column[block]]
            value = a["name"][len(block) + 1:]
            names[a["idx"]] = f"{source}={value if value in labels else MISSING}"
        else:
            names[a["idx"]] = a["name"]
    return [names[i] for i in range(len(names))]


def importance_topk(model: PipelineModel, k: int, rows: DataFrame) -> DataFrame:
    """Global feature importance, top-k, slots named by the features column's own metadata.

    ``rows``: any frame of the model's input columns (only its schema is used)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    named = [(n, float(v)) for n, v in zip(feature_names(model, rows), imp, strict=True)]
    df = rows.sparkSession.createDataFrame(named, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)
