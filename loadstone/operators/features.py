"""Leak-free demand features and weather features over hourly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.functions import calendar as cal
from loadstone.functions import weather as wx
from loadstone.operators.series import CHUNK_ROWS, hour_number, rolling_mean, running, windowed

LAGS = (1, 3, 24, 168)
ROLLS = (24, 72, 168)


def lag_columns(v: str = "demand_mw") -> dict:
    return {f"demand_lag_{n}h": (lambda w, n=n: F.lag(v, n).over(w)) for n in LAGS}


def roll_columns(v: str = "demand_mw") -> dict:
    """Mean, sample std, min, max of the ``n`` hours before the row."""
    out = {}
    for n in ROLLS:
        for stat, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"demand_roll_{n}h_{stat}"] = lambda w, n=n, agg=agg: agg(v).over(w.rowsBetween(-n, -1))
    return out


def ratio(num: str, den: str) -> Column:
    return F.col(num) / wx.at_least(den, 1.0)


def derived_columns() -> dict[str, Column]:
    return {
        "demand_momentum_short": F.col("demand_lag_1h") - F.col("demand_lag_3h"),
        "demand_momentum_long": F.col("demand_lag_1h") - F.col("demand_lag_24h"),
        "demand_ratio_24h": ratio("demand_lag_24h", "demand_roll_24h_mean"),
        "demand_ratio_168h": ratio("demand_lag_168h", "demand_roll_168h_mean"),
    }


DERIVED = ["demand_momentum_short", "demand_momentum_long", "demand_ratio_24h", "demand_ratio_168h"]
AUTOREGRESSIVE = [*lag_columns(), "ramp_rate", *roll_columns(), *DERIVED]


def _ar_windows(v: str) -> dict:
    return {**lag_columns(v), "ramp_rate": lambda w: F.lag(v, 1).over(w) - F.lag(v, 2).over(w), **roll_columns(v)}


def autoregressive(df: DataFrame, keys: Sequence[str] = ("region",), v: str = "demand_mw",
                   order: str = "h", chunk: int = CHUNK_ROWS) -> DataFrame:
    """The 21 demand features; one shuffle, every frame ends at the row before."""
    out = windowed(df, keys, order, _ar_windows(v), before=max(LAGS), chunk=chunk)
    return out.select("*", *[c.alias(n) for n, c in derived_columns().items()])


TEMPERATURE, HUMIDITY = "temperature_2m", "relative_humidity_2m"
DEVIATION_ROWS = 720


def _weather_scalars() -> dict[str, Column]:
    return {
        "cooling_degree_days": wx.cdd(TEMPERATURE), "heating_degree_days": wx.hdd(TEMPERATURE), "heat_index": wx.heat_index(TEMPERATURE, HUMIDITY),
        "wind_power_estimate": wx.wind_power("wind_speed_80m"), "solar_capacity_factor": wx.solar_factor("shortwave_radiation"),
    }


def _weather_windows() -> dict:
    return {
        "temperature_deviation": lambda w: F.col(TEMPERATURE) - rolling_mean(TEMPERATURE, w, 1 - DEVIATION_ROWS, 0),
        "cdd_accum_24h": lambda w: F.avg("cooling_degree_days").over(w.rowsBetween(-23, 0)),
        "cdd_accum_72h": lambda w: F.avg("cooling_degree_days").over(w.rowsBetween(-71, 0)),
    }


def _weather_products() -> dict[str, Column]:
    return {"cdd_squared": F.pow("cooling_degree_days", F.lit(2.0)), "cdd_x_humidity": F.col("cooling_degree_days") * F.col(HUMIDITY) / 100.0}


def weather_features(df: DataFrame, keys: Sequence[str] = ("region",), order: str = "h",
                     chunk: int = CHUNK_ROWS) -> DataFrame:
    """Degree days, cooling response, deviation from the month, wind and solar."""
    base = df.select("*", *[c.alias(n) for n, c in _weather_scalars().items()])
    out = windowed(base, keys, order, _weather_windows(), before=DEVIATION_ROWS - 1, chunk=chunk)
    return out.select("*", *[c.alias(n) for n, c in _weather_products().items()])


def impute_exogenous(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("region",),
                     order: str = "h", chunk: int = CHUNK_ROWS) -> DataFrame:
    """Forward fill, then backward fill, then zero."""
    specs = {}
    for c in cols:
        specs[f"_p_{c}"] = ("last", F.col(c))
        specs[f"_n_{c}"] = ("next", F.col(c))
    filled = running(df, keys, order, specs, chunk)
    return filled.select(*[
        F.coalesce(f"_p_{c}", f"_n_{c}", F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns if c != "_chunk"
    ])


WEATHER_INPUTS = ["temperature_2m", "relative_humidity_2m", "wind_speed_80m", "shortwave_radiation"]
WEATHER_DERIVED = ["cooling_degree_days", "heating_degree_days", "temperature_deviation", "cdd_accum_24h",
                   "cdd_accum_72h", "cdd_squared", "heat_index", "cdd_x_humidity",
                   "wind_power_estimate", "solar_capacity_factor"]


def feature_table(merged: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts", chunk: int = CHUNK_ROWS) -> DataFrame:
    """Merged demand and weather to the model table, warm-up rows dropped.

    All frames are evaluated on one chunked shuffle, which the imputation of the
    exogenous columns reuses; demand features are never imputed.
    """
    base = merged.withColumn("h", hour_number(ts)).select("*", *[c.alias(n) for n, c in {**_weather_scalars(), **cal.cyclical(ts)}.items()])
    out = windowed(base, keys, "h", {**_weather_windows(), **_ar_windows("demand_mw")}, before=DEVIATION_ROWS - 1, chunk=chunk, keep_chunk=True)
    out = out.select("*", *[c.alias(n) for n, c in {**_weather_products(), **derived_columns()}.items()],
                     (F.col(TEMPERATURE) * F.col("hour_sin")).alias("temp_x_hour"))
    out = impute_exogenous(out, [*WEATHER_INPUTS, *WEATHER_DERIVED, "temp_x_hour"], keys)
    return cal.with_holiday_flag(out.na.drop(subset=AUTOREGRESSIVE), ts)


def temporal_snapshot(df: DataFrame, keys: Sequence[str] = ("region",), v: str = "demand_mw",
                      order: str = "h", chunk: int = CHUNK_ROWS) -> DataFrame:
    """Serving-side features: clock-hour lags and windows over hours present.

    Works on sparse rows, because frames are ranges of the hour number. A window
    of one value has deviation 0 here, unlike the training-side rolling columns.
    """
    real = F.when(F.col(v) > 0, F.col(v))
    exprs = {f"demand_lag_{n}h": (lambda w, n=n: F.first(real).over(w.rangeBetween(-n, -n))) for n in (1, 2, 3, 24, 168)}
    for n in ROLLS:
        f = lambda w, n=n: w.rangeBetween(-n, -1)
        exprs[f"demand_roll_{n}h_mean"] = lambda w, f=f: F.avg(real).over(f(w))
        exprs[f"demand_roll_{n}h_std"] = lambda w, f=f: F.when(F.count(real).over(f(w)) == 1, 0.0).otherwise(F.stddev_samp(real).over(f(w)))
        exprs[f"demand_roll_{n}h_min"] = lambda w, f=f: F.min(real).over(f(w))
        exprs[f"demand_roll_{n}h_max"] = lambda w, f=f: F.max(real).over(f(w))
    out = windowed(df, keys, order, exprs, before=168, chunk=chunk)
    return out.select("*", (F.col("demand_lag_1h") - F.col("demand_lag_2h")).alias("ramp_rate"),
                      *[c.alias(n) for n, c in derived_columns().items()])


MAX_HOLE_HOURS = 6
SEASONAL_DAYS = 7


def impute_hours(df: DataFrame, keys: Sequence[str] = ("region",), v: str = "demand_mw",
                 order: str = "h", name: str = "imputed_mw", chunk: int = CHUNK_ROWS) -> DataFrame:
    """Value of an absent hour on a dense spine.

    A hole of at most six hours is interpolated between its edges; a longer one
    takes the same clock hour of the nearest of the last seven days; else null.
    """
    real = F.when(F.col(v) > 0, F.col(v))
    edge = F.when(real.isNotNull(), F.struct(F.col(order).alias("h"), real.alias("v")))
    n = MAX_HOLE_HOURS
    exprs = {
        "_lo": lambda w: F.last(edge, True).over(w.rowsBetween(-n, -1)),
        "_hi": lambda w: F.first(edge, True).over(w.rowsBetween(1, n)),
        **{f"_d{k}": (lambda w, k=k: F.lag(real, 24 * k).over(w)) for k in range(1, SEASONAL_DAYS + 1)},
    }
    out = windowed(df, keys, order, exprs, before=24 * SEASONAL_DAYS, after=n, chunk=chunk)
    lo, hi = F.col("_lo"), F.col("_hi")
    line = F.when(
        hi["h"] - lo["h"] - 1 <= n,
        lo["v"] + (hi["v"] - lo["v"]) * (F.col(order) - lo["h"]) / (hi["h"] - lo["h"]),
    )
    value = F.coalesce(real, line, *[F.col(f"_d{k}") for k in range(1, SEASONAL_DAYS + 1)])
    return out.select(*df.columns, value.alias(name))
