"""Forecast error metrics as aggregate columns over (actual, predicted) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.operators.quantiles import percentiles
from loadstone.operators.series import newest

# Fixed values.
MAPE_MASK = 1e-6
R2_MIN_SS = 1e-10
COVERAGE_TARGET = 0.80
COVERAGE_RECENT = 168
MAX_ABS_BIAS_PCT = 2.0
MAX_MAPE_REGRESSION_PTS = 0.5
MIN_SIGN_CONSISTENCY = 0.75
MIN_T = 2.0
MIN_WINDOWS = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ape(a="actual", p="predicted") -> Column:
    """Absolute percentage error of a row, null when the actual is zero."""
    a, p = _c(a), _c(p)
    return F.when(a != 0, F.abs(a - p) / F.abs(a) * 100)


def smape_row(a="actual", p="predicted") -> Column:
    a, p = _c(a), _c(p)
    den = F.abs(a) + F.abs(p)
    return F.when(den != 0, F.lit(200.0) * F.abs(a - p) / den)


def residual(a="actual", p="predicted") -> Column:
    return _c(a) - _c(p)


def mape(a="actual", p="predicted") -> Column:
    """Mean APE over actuals above the mask; infinite when none qualifies."""
    a, p = _c(a), _c(p)
    return F.coalesce(F.avg(F.when(F.abs(a) > MAPE_MASK, F.abs((a - p) / a))) * 100, F.lit(float("inf")))


def positive_mape(a="actual", p="predicted") -> Column:
    """The skill flavour: positive actuals only, null when none qualifies."""
    a, p = _c(a), _c(p)
    return F.avg(F.when(a > 0, F.abs(a - p) / a)) * 100


def rmse(a="actual", p="predicted") -> Column:
    return F.sqrt(F.avg(F.pow(_c(a) - _c(p), F.lit(2.0))))


def mae(a="actual", p="predicted") -> Column:
    return F.avg(F.abs(_c(a) - _c(p)))


def r2(a="actual", p="predicted") -> Column:
    """One-pass R²; the total sum of squares comes from the population variance."""
    a, p = _c(a), _c(p)
    total = F.var_pop(a) * F.count(a)
    return F.when(total < R2_MIN_SS, 0.0).otherwise(1 - F.sum(F.pow(a - p, F.lit(2.0))) / total)


def wape(a="actual", p="predicted") -> Column:
    a, p = _c(a), _c(p)
    den = F.sum(F.when(p.isNotNull(), F.abs(a)))
    return F.when(den > 0, F.sum(F.abs(a - p)) / den * 100)


def bias_pct(a="actual", p="predicted") -> Column:
    a, p = _c(a), _c(p)
    return F.avg(F.when(a != 0, (p - a) / a)) * 100


def smape(a="actual", p="predicted") -> Column:
    return F.avg(smape_row(a, p))


def error_by_hour(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    err = F.abs(F.col("actual") - F.col("predicted"))
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(
        F.avg(err).alias("mean_abs_error"), F.stddev_samp(err).alias("std_abs_error"), F.count(err).alias("count"))


def scorecard(df: DataFrame, keys: Sequence[str], a="actual", p="predicted") -> DataFrame:
    """MAPE, median APE, MAE, WAPE and n per group.

    Rows are first counted per percentage error; the sums and the median are both
    taken from that one shuffle, so the input is computed once.
    """
    a, p = _c(a), _c(p)
    err = F.abs(a - p)
    counts = df.select(*keys, ape(a, p).alias("_ape"), err.alias("_err"), F.when(err.isNotNull(), F.abs(a)).alias("_abs")).groupBy(*keys, "_ape").agg(
        F.sum("_err").alias("_err"), F.sum("_abs").alias("_abs"), F.count("_err").alias("_m"), F.count("*").alias("_n"))
    weight = F.when(F.col("_ape").isNotNull(), F.col("_n"))
    sums = counts.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_ape") * weight), F.sum(weight)).alias("mape"), F.try_divide(F.sum("_err"), F.sum("_m")).alias("mae"),
        (F.try_divide(F.sum("_err"), F.sum("_abs")) * 100).alias("wape"), F.sum("_n").alias("n"))
    return sums.join(percentiles(counts, keys, {"median_ape": (F.col("_ape"), 0.5)}, counted="_n"), list(keys), "left")


def macro_average(per_region: DataFrame, keys: Sequence[str], metrics: Sequence[str], n: str = "n") -> DataFrame:
    """Fleet statistic: mean over regions (one region, one vote) and total rows."""
    return per_region.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.sum(n).alias(n), F.count("*").alias("n_regions"))


def error_quantiles(df: DataFrame, keys: Sequence[str], low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Empirical residual quantiles per group; zero when there is no residual."""
    q = percentiles(df, keys, {"lower_error": (residual(), low), "upper_error": (residual(), high)})
    n = df.groupBy(*keys).agg(F.count(residual()).alias("sample_size"))
    return n.join(q, list(keys), "left").na.fill(0.0, ["lower_error", "upper_error"])


def apply_interval(df: DataFrame, quantiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(quantiles.select(*keys, "lower_error", "upper_error"), list(keys)).select(
        *df.columns, (F.col("predicted") + F.col("lower_error")).alias("lower"), (F.col("predicted") + F.col("upper_error")).alias("upper"))


def interval_coverage(df: DataFrame, keys: Sequence[str], ts: str = "ts", recent: int = COVERAGE_RECENT,
                      target: float = COVERAGE_TARGET) -> DataFrame:
    """Share of actuals inside the band, overall and over the newest rows."""
    inside = (F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))
    share = F.avg(inside.cast("double"))
    overall = df.groupBy(*keys).agg(share.alias("overall_coverage"))
    late = newest(df, keys, ts, recent).groupBy(*keys).agg(share.alias("recent_coverage"))
    return overall.join(late, list(keys)).withColumn("drift", F.col("recent_coverage") - target)


def paired_verdict(deltas: DataFrame, keys: Sequence[str], d: str = "delta") -> DataFrame:
    """Is treatment better than control over paired windows? Positive favours treatment.

    One row per evaluation window, so a group holds as many rows as windows.
    """
    x = deltas.filter(F.col(d).isNotNull() & ~F.isnan(d))
    out = x.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.min(d).alias("worst_window"), F.max(d).alias("best_window"),
        F.stddev_samp(d).alias("_sd"), F.percentile(d, F.lit(0.5)).alias("median"), F.count_if(F.col(d) > 0).alias("_pos"), F.count_if(F.col(d) < 0).alias("_neg"))
    enough = F.col("n") >= MIN_WINDOWS
    se = F.when(enough, F.col("_sd") / F.sqrt("n"))
    wins = F.when(F.col("mean") > 0, F.col("_pos")).when(F.col("mean") < 0, F.col("_neg")).otherwise(F.col("n") - F.col("_pos") - F.col("_neg"))
    cons = F.when(enough, F.when(se == 0, F.when(F.col("mean") != 0, 1.0).otherwise(0.0)).otherwise(wins / F.col("n")))
    split = (F.col("median") != 0) & (F.signum("mean") != F.signum("median"))
    reason = (
        F.when(~enough, "too_few_windows").when(F.col("mean") == 0, "no_difference").when(split, "mean_median_disagree")
        .when((se > 0) & (F.abs("mean") < MIN_T * se), "within_noise").when(cons < MIN_SIGN_CONSISTENCY, "not_consistent")
        .otherwise("decisive")
    )
    return out.select(
        *keys, "n", "mean", "median", "worst_window", "best_window", se.alias("stderr"),
        F.when(se > 0, F.col("mean") / se).alias("t"), cons.alias("sign_consistency"), reason.alias("reason"),
        (reason == "decisive").alias("decisive"),
        F.when(reason == "decisive", F.when(F.col("mean") > 0, "treatment").otherwise("control")).alias("winner"))


def satisficing(bias: str | Column, control_mape: str | Column, treatment_mape: str | Column) -> Column:
    """List of failed constraints; empty when the treatment may ship."""
    b, c, t = _c(bias), _c(control_mape), _c(treatment_mape)
    return F.array_compact(F.array(
        F.when(b.isNull(), "bias not measured").when(b < -MAX_ABS_BIAS_PCT, "under-forecasting").when(b > MAX_ABS_BIAS_PCT, "over-forecasting"),
        F.when(c.isNull() | t.isNull(), "mape not measured").when(t - c > MAX_MAPE_REGRESSION_PTS, "mape regression"),
    ))

