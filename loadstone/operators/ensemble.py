"""Ensemble weights and combination, smoothed weighting inputs, holdout scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadstone.operators import metrics as mt
from loadstone.operators.scans import scan, smoothing
from loadstone.operators.series import running, with_position

# Fixed values.
WEIGHT_EXPONENT = 3.0
EWMA_ALPHA = 0.3
FIT_FRACTION = 0.5
MIN_SPLIT_HOURS = 24


def usable(m: str | Column) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.coalesce((m > 0) & ~F.isnan(m) & (m < float("inf")), F.lit(False))


def weights(scores: DataFrame, keys: Sequence[str], mape: str = "mape") -> DataFrame:
    """Inverse cubed-error weights; equal for all when any member is unusable.

    One row per member, so a window per group holds as many rows as models.
    """
    w = Window.partitionBy(*keys)
    inv = F.when(usable(mape), F.pow(1.0 / F.col(mape), F.lit(WEIGHT_EXPONENT)))
    every = F.min(usable(mape).cast("int")).over(w) == 1
    return scores.select(
        "*", F.when(every, inv / F.sum(inv).over(w)).otherwise(1.0 / F.count("*").over(w)).alias("weight"),
        F.when(every, "inverse_mape_cubed").otherwise("equal").alias("rule"))


def usable_weights(scores: DataFrame, keys: Sequence[str], mape: str = "mape") -> DataFrame:
    """The lower-level rule: unusable members are dropped, none usable means equal."""
    w = Window.partitionBy(*keys)
    inv = F.when(usable(mape), F.pow(1.0 / F.col(mape), F.lit(WEIGHT_EXPONENT)))
    total = F.sum(inv).over(w)
    return scores.select("*", F.when(total.isNull(), 1.0 / F.count("*").over(w)).otherwise(inv / total).alias("weight")).filter("weight IS NOT NULL")


def combine(forecasts: DataFrame, w: DataFrame, keys: Sequence[str], target: Sequence[str], model: str = "model") -> DataFrame:
    """Weighted mean over the members present, and whether it lies between them."""
    j = forecasts.join(w.select(*keys, model, "weight"), [*keys, model], "left")
    weight = F.when(F.col("predicted").isNotNull(), F.coalesce("weight", F.lit(0.0)))
    total = F.sum(weight)
    value = F.when(total > 0, F.sum(weight * F.col("predicted")) / total).otherwise(F.avg("predicted"))
    g = j.groupBy(*target).agg(value.alias("predicted"), F.min("predicted").alias("_lo"), F.max("predicted").alias("_hi"), F.count("predicted").alias("members"))
    return g.select(*target, "predicted", "members", ((F.col("predicted") >= F.col("_lo") - 1e-6) & (F.col("predicted") <= F.col("_hi") + 1e-6)).alias("within_members"))


def ewma(history: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float = EWMA_ALPHA, name: str = "ewma") -> DataFrame:
    """Exponential smoothing carried through every row, unusable values skipped; chunks are combined as affine maps."""
    pos = with_position(history.filter(usable(value)), list(keys), order, "_pos")
    return scan(pos, keys, "_pos", smoothing(value, usable(value), alpha, name)).drop("_pos")


def weighting_input(meta: DataFrame, smoothed_on: bool = True) -> DataFrame:
    """Which error feeds the weights, and what the shadow arm would use."""
    ok = usable("mape_ewma")
    if smoothed_on:
        served, label, shadow = F.when(ok, F.col("mape_ewma")).otherwise(F.col("mape")), F.when(ok, "mape_ewma").otherwise("holdout_mape"), F.col("mape")
    else:
        served, label, shadow = F.col("mape"), F.lit("holdout_mape"), F.when(ok, F.col("mape_ewma"))
    return meta.select("*", served.alias("weighting_mape"), label.alias("weight_input"), shadow.alias("shadow_mape"))


def holdout_score(holdout: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts") -> DataFrame:
    """Ensemble scored on the second half with weights fitted on the first.

    Falls back to in-sample weights when a half is too short or a member cannot be
    scored on the first half. ``holdout`` is long: key, model, ts, actual, predicted.
    """
    keys = list(keys)
    hours_ = holdout.select(*keys, ts).distinct()
    hours_ = hours_.withColumn("_o", F.unix_timestamp(ts))
    pos = with_position(hours_, keys, "_o", "_pos").drop("_o")
    n = hours_.groupBy(*keys).agg(F.count("*").alias("_n"))
    x = holdout.join(pos, [*keys, ts]).join(n, keys).withColumn("_split", F.floor(F.col("_n") * FIT_FRACTION)).withColumn("_fit", F.col("_pos") < F.col("_split"))
    scores = x.groupBy(*keys, "model").agg(
        mt.mape().alias("mape"), F.avg(F.when(F.col("_fit") & (F.abs("actual") > mt.MAPE_MASK), F.abs((F.col("actual") - F.col("predicted")) / F.col("actual")))).alias("_fit_mape"))
    full = weights(scores, keys).select(*keys, "model", F.col("weight").alias("w_full"), "rule")
    oos = weights(scores, keys, "_fit_mape").select(*keys, "model", F.col("weight").alias("w_fit"), (F.col("rule") == "inverse_mape_cubed").alias("_ok"))
    j = x.join(full, [*keys, "model"]).join(oos, [*keys, "model"])
    per = j.groupBy(*keys, ts).agg(
        F.first("actual").alias("actual"), F.min((~F.col("_fit")).cast("int")).alias("_late"), F.first("_n").alias("_n"), F.first("_split").alias("_split"), F.first("_ok").alias("_ok"),
        F.first("rule").alias("weight_rule"), F.try_divide(F.sum(F.col("w_full") * F.col("predicted")), F.sum("w_full")).alias("p_full"), F.try_divide(F.sum(F.col("w_fit") * F.col("predicted")), F.sum("w_fit")).alias("p_fit"))
    split_ok = (F.col("_split") >= MIN_SPLIT_HOURS) & (F.col("_n") - F.col("_split") >= MIN_SPLIT_HOURS) & F.col("_ok")
    rows = per.withColumn("_oos", split_ok).filter("NOT _oos OR _late = 1").withColumn("predicted", F.when(F.col("_oos"), F.col("p_fit")).otherwise(F.col("p_full")))
    return rows.groupBy(*keys, "weight_rule", F.when(F.col("_oos"), "out_of_sample").otherwise("in_sample").alias("scored")).agg(
        mt.mape().alias("mape"), mt.rmse().alias("rmse"), mt.mae().alias("mae"), mt.r2().alias("r2"), F.count("*").alias("n"))


def latest_before(origins: DataFrame, history: DataFrame, keys: Sequence[str], at: str = "origin", known: str = "trained_at") -> DataFrame:
    """As-of lookup: newest history row strictly before each origin, null if none.

    Both sides are sorted together and the last history value is carried forward
    over chunks, so no origin is paired with more than one row.
    """
    keys = list(keys)
    vals = [c for c in history.columns if c not in (*keys, known)]
    left = origins.withColumn("_t", F.unix_micros(at) * 2).withColumn("_row", F.lit(None).cast(history.select(F.struct(known, *vals).alias("r")).schema["r"].dataType))
    # Rows that tie on the time are settled whole: the greatest by its columns in order.
    right = history.groupBy(*keys, known).agg(F.max(F.struct(*vals)).alias("_v")).select(
        *keys, (F.unix_micros(known) * 2 + 1).alias("_t"), F.struct(known, *[F.col(f"_v.{v}").alias(v) for v in vals]).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    span = 30 * 86400 * 1_000_000 * 2
    got = running(both, keys, "_t", {"_last": ("last", F.col("_row"))}, chunk=span)
    return got.filter(F.col(at).isNotNull()).select(*origins.columns, *[F.col(f"_last.{c}").alias(c) for c in (known, *vals)])

