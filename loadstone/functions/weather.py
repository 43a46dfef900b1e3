"""Weather-derived columns. A null input gives a null output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BASE_F = 65.0
MPH_TO_MS = 0.44704
WIND_CUT_IN_MS = 3.0
WIND_RATED_MS = 12.0
WIND_CUT_OUT_MS = 25.0
SOLAR_RATED = 1000.0
ROTHFUSZ = (-42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783,
            -0.05481717, 0.00122874, 0.00085282, -0.00000199)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, low, high) -> Column:
    """Clamp to [low, high]; ``greatest``/``least`` alone would turn null into a bound."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def at_least(x, low) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def cdd(temp_f) -> Column:
    return at_least(_c(temp_f) - BASE_F, 0.0)


def hdd(temp_f) -> Column:
    return at_least(F.lit(BASE_F) - _c(temp_f), 0.0)


def heat_index(temp_f, humidity) -> Column:
    t, r = _c(temp_f), clip(humidity, 0.0, 100.0)
    terms = (F.lit(1.0), t, r, t * r, t * t, r * r, t * t * r, t * r * r, t * t * r * r)
    full = sum((F.lit(k) * x for k, x in zip(ROTHFUSZ, terms)), F.lit(0.0))
    mild = F.lit(0.5) * (t + 61.0 + (t - 68.0) * 1.2 + r * 0.094)
    return F.when(t < 80.0, mild).otherwise(full)


def wind_power(speed_mph) -> Column:
    v = _c(speed_mph) * MPH_TO_MS
    share = F.pow(v / WIND_RATED_MS, F.lit(3.0))
    idle = (v < WIND_CUT_IN_MS) | (v > WIND_CUT_OUT_MS)
    return F.when(v.isNotNull(), F.when(idle, 0.0).otherwise(F.least(share, F.lit(1.0))))


def solar_factor(irradiance) -> Column:
    return clip(_c(irradiance) / SOLAR_RATED, 0.0, 1.0)


def circular_mean(degrees) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    rad = F.radians(_c(degrees))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), F.lit(360.0))
