"""Direct multi-horizon training table and the pooled learned forecaster."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadstone.operators import metrics as mt
from loadstone.operators.features import AUTOREGRESSIVE, temporal_snapshot

# Fixed values.
ORIGIN_STRIDE = 12
MIN_SEED = 168


def direct_table(hourly: DataFrame, exog: Sequence[str], horizons: Sequence[int], stride: int = ORIGIN_STRIDE, min_seed: int = MIN_SEED,
                 keys: Sequence[str] = ("region",)) -> DataFrame:
    """Rows of (origin snapshot, horizon, exogenous at target, target).

    ``hourly`` is a dense spine with ``h``, demand_mw and the exogenous columns.
    Origins are every ``stride`` hours from ``min_seed`` on; each one meets one row
    per horizon by an equality join.
    """
    keys = list(keys)
    first = hourly.groupBy(*keys).agg(F.min("h").alias("_h0"))
    snap = temporal_snapshot(hourly.select(*keys, "h", "demand_mw"), keys).join(first, keys)
    i = F.col("h") - F.col("_h0")
    seeds = snap.filter((i >= min_seed) & ((i - min_seed) % stride == 0)).select(*keys, F.col("h").alias("origin_h"), *AUTOREGRESSIVE)
    want = seeds.select("*", F.explode(F.array(*[F.lit(n) for n in horizons])).alias("horizon_h"))
    want = want.withColumn("_t", F.col("origin_h") + F.col("horizon_h") - 1)
    target = hourly.select(*keys, F.col("h").alias("_t"), "ts", *exog, F.col("demand_mw").alias("target"))
    return want.join(target, [*keys, "_t"]).drop("_t")


MISSING = -9999.0


def prepared(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing inputs as their own value, which trees split off; rows are kept."""
    return df.na.fill(MISSING, list(features))


def pooled_forecaster(features: Sequence[str], label: str = "target", max_iter: int = 10, max_depth: int = 4, seed: int = 7) -> Pipeline:
    """One distributed model over all regions at once."""
    vec = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[vec, GBTRegressor(featuresCol="features", labelCol=label, predictionCol="predicted", maxIter=max_iter, maxDepth=max_depth, seed=seed)])


def time_folds(df: DataFrame, order: str, n_splits: int = 5) -> list[tuple[object, object]]:
    """Boundaries of time-ordered folds: train before the first, test up to the second.

    Only the two ends of the order column reach the driver.
    """
    a, b = df.agg(F.min(order), F.max(order)).first()
    step = (b - a + 1) / (n_splits + 1)
    return [(a + step * (k + 1), a + step * (k + 2)) for k in range(n_splits)]


def cross_validate(df: DataFrame, features: Sequence[str], order: str, n_splits: int = 5, label: str = "target", **params) -> DataFrame:
    """Error per fold; every fold trains on rows strictly before its test rows."""
    out = None
    for k, (cut, end) in enumerate(time_folds(df, order, n_splits)):
        train = df.filter(F.col(order) < cut)
        if train.isEmpty():
            continue
        model = pooled_forecaster(features, label, **params).fit(train)
        part = model.transform(df.filter((F.col(order) >= cut) & (F.col(order) < end))).agg(
            mt.mape(label, "predicted").alias("mape"), mt.mae(label, "predicted").alias("mae"), F.count("*").alias("n")).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """One row per feature, as many as the model has inputs."""
    imp = model.stages[-1].featureImportances
    return spark.createDataFrame([(f, float(imp[i])) for i, f in enumerate(features)], "feature STRING, importance DOUBLE")


def apply_forecaster(frame: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], out: str = "predicted") -> DataFrame:
    """Run a caller's vectorised predict function over Arrow batches of a frame."""
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(**{out: predict(pdf).astype("float64")})

    schema = frame.withColumn(out, F.lit(None).cast("double")).schema
    return frame.mapInPandas(batches, schema)
