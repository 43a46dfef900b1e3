"""Ordered and capped tables: work lists, repeats, drivers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.functions.text import driver_line, feature_label
from loadstone.operators.series import previous

# Fixed values.
REFRESH_DAYS = 90
MAX_REBUILD = 10
LABELS = {
    "temperature_2m": "Temperature",
    "apparent_temperature": "Feels-Like Temp",
    "relative_humidity_2m": "Humidity",
    "dew_point_2m": "Dew Point",
    "wind_speed_10m": "Wind (10m)",
    "wind_speed_80m": "Wind Speed",
    "wind_speed_120m": "Wind (120m)",
    "wind_direction_10m": "Wind Direction",
    "shortwave_radiation": "Solar Radiation",
    "direct_normal_irradiance": "Direct Irradiance",
    "diffuse_radiation": "Diffuse Radiation",
    "cloud_cover": "Cloud Cover",
    "precipitation": "Precipitation",
    "snowfall": "Snowfall",
    "surface_pressure": "Pressure",
    "soil_temperature_0cm": "Soil Temp",
    "weather_code": "Weather Code",
    "cooling_degree_days": "Cooling Demand",
    "cdd_accum_24h": "Heat Build-Up (24h)",
    "cdd_accum_72h": "Heat Build-Up (3-Day)",
    "cdd_squared": "Cooling Demand (Non-Linear)",
    "heat_index": "Heat Index (Feels-Like)",
    "cdd_x_humidity": "Humid-Heat Cooling Load",
    "heating_degree_days": "Heating Demand",
    "temperature_deviation": "Temp Anomaly",
    "wind_power_estimate": "Wind Power",
    "solar_capacity_factor": "Solar Factor",
    "hour_sin": "Time of Day (sin)",
    "hour_cos": "Time of Day (cos)",
    "dow_sin": "Day of Week (sin)",
    "dow_cos": "Day of Week (cos)",
    "is_holiday": "Holiday",
    "temp_x_hour": "Temp x Hour",
    "demand_lag_1h": "Demand (1h ago)",
    "demand_lag_3h": "Demand (3h ago)",
    "demand_lag_24h": "Demand (24h ago)",
    "demand_lag_168h": "Demand (7d ago)",
    "ramp_rate": "Ramp Rate",
    "demand_momentum_short": "Short Momentum",
    "demand_momentum_long": "Long Momentum",
    "demand_ratio_24h": "24h Demand Ratio",
    "demand_ratio_168h": "7d Demand Ratio",
    "demand_roll_24h_mean": "Avg Demand (24h)",
    "demand_roll_24h_std": "Demand Volatility (24h)",
    "demand_roll_24h_min": "Min Demand (24h)",
    "demand_roll_24h_max": "Max Demand (24h)",
    "demand_roll_72h_mean": "Avg Demand (3d)",
    "demand_roll_72h_std": "Demand Volatility (3d)",
    "demand_roll_72h_min": "Min Demand (3d)",
    "demand_roll_72h_max": "Max Demand (3d)",
    "demand_roll_168h_mean": "Avg Demand (7d)",
    "demand_roll_168h_std": "Demand Volatility (7d)",
    "demand_roll_168h_min": "Min Demand (7d)",
    "demand_roll_168h_max": "Max Demand (7d)",
    "hour": "Hour of Day",
    "day_of_week": "Day of Week",
    "month": "Month",
    "day_of_year": "Day of Year",
    "is_weekend": "Weekend",
}


def stalest_first(regions: DataFrame, built: DataFrame, now: Column, min_age: int = REFRESH_DAYS, cap: int = MAX_REBUILD) -> DataFrame:
    """Regions to rebuild: never built first, then by age, at most ``cap`` a run."""
    age = F.datediff(now, F.col("built_at"))
    j = regions.join(built, "region", "left").select("region", age.alias("age_days"))
    return j.filter(F.col("age_days").isNull() | (F.col("age_days") >= min_age)).orderBy(F.desc_nulls_first("age_days"), "region").limit(cap)


def drop_repeats(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before them."""
    x = previous(df, keys, order, {"_prev": value})
    return x.filter(~F.col(value).eqNullSafe(F.col("_prev"))).drop("_prev")


def top_drivers(wide: DataFrame, ids: Sequence[str], features: Sequence[str], top: int = 3) -> DataFrame:
    """Largest contributions of each row by size, labelled and formatted.

    The contributions of a row are sorted inside the row; nothing is shuffled.
    """
    entries = F.array(*[F.struct(F.abs(F.col(c)).alias("size"), F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features])
    best = F.slice(F.sort_array(F.filter(entries, lambda e: e["value"].isNotNull()), asc=False), 1, top)
    x = wide.select(*ids, F.posexplode(best).alias("pos", "e"))
    label = feature_label(F.col("e.feature"), LABELS)
    return x.select(*ids, (F.col("pos") + 1).alias("rank"), F.col("e.feature").alias("feature"), label.alias("label"), F.col("e.value").alias("value"), driver_line(label, F.col("e.value")).alias("line"))


def top_importances(importances: DataFrame, n: int = 10) -> DataFrame:
    """Features by importance, largest first."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n).withColumn("label", feature_label(F.col("feature"), LABELS))
