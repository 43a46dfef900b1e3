"""Shadow weighting arm: a ledger of both arms on the same hours, and its verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadstone.operators import ensemble as en
from loadstone.operators import metrics as mt
from loadstone.operators.cleaning import drop_low_actuals, keep_lead

# Fixed values.
MIN_DAYS = 14
ARMS = ("served", "shadow")


def ledger(forecasts: DataFrame, meta: DataFrame, keys: Sequence[str] = ("region",), target: Sequence[str] = ("region", "ts")) -> DataFrame:
    """Both weightings combined over the same member forecasts, joined per hour.

    ``meta`` holds key, model and the two errors that feed the weights. A region
    is recorded only when every member has a usable shadow error.
    """
    served = en.combine(forecasts, en.weights(meta.select(*keys, "model", F.col("weighting_mape").alias("mape")), keys), keys, target)
    other = en.weights(meta.select(*keys, "model", F.col("shadow_mape").alias("mape")), keys).filter("rule <> 'equal'")
    shadow = en.combine(forecasts.join(other.select(*keys).distinct(), list(keys), "left_semi"), other, keys, target)
    return served.select(*target, F.col("predicted").alias("served")).join(shadow.select(*target, F.col("predicted").alias("shadow")), list(target))


def filtered(records: DataFrame, max_lead: int = 1, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Known far leads and low actuals out, in that order."""
    return drop_low_actuals(records.filter(keep_lead(max_lead)), keys)


def evaluate(records: DataFrame, min_days: float = MIN_DAYS) -> DataFrame:
    """One row: macro and pooled statistics of both arms, wins and the verdict.

    The control is checked first: if it breaks the bias constraint itself, no
    verdict on the treatment is given. One roll-up gives the regional and pooled rows.
    """
    metrics = ("bias_pct", "mape", "wape")
    long = records.filter("actual > 0").unpivot(["region", "ts", "actual"], list(ARMS), "arm", "predicted").filter("predicted IS NOT NULL")
    days = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400
    g = long.rollup("arm", "region").agg(
        F.grouping_id().alias("level"), mt.bias_pct().alias("bias_pct"), F.avg(mt.ape()).alias("mape"), mt.wape().alias("wape"), days.alias("days"))
    served = F.max(F.when(F.col("arm") == "served", F.col("mape"))).over(Window.partitionBy("level", "region"))
    g = g.withColumn("_served", served)
    region = F.col("level") == 0
    out = g.agg(
        *[F.avg(F.when((F.col("level") == n) & (F.col("arm") == a), F.col(m))).alias(f"{t}_{a}_{m}") for n, t in enumerate(("macro", "pooled")) for a in ARMS for m in metrics],
        F.count_if(region & (F.col("arm") == "served")).alias("n_regions"), F.count_if(region & (F.col("arm") == "shadow") & (F.col("mape") < F.col("_served"))).alias("shadow_wins"),
        F.percentile(F.when(region & (F.col("arm") == "served"), F.col("days")), F.lit(0.5)).alias("span_days"))
    broken = (F.abs("macro_served_bias_pct") > mt.MAX_ABS_BIAS_PCT) | (F.abs("pooled_served_bias_pct") > mt.MAX_ABS_BIAS_PCT)
    fails = mt.satisficing("macro_shadow_bias_pct", "macro_served_mape", "macro_shadow_mape")
    verdict = F.when(broken, "control_fails_constraint").when(F.col("span_days") < min_days, "too_short").when(F.size(fails) > 0, F.array_join(fails, ",")).otherwise("passes")
    return out.withColumn("verdict", verdict)
