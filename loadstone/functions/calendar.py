"""Calendar columns and the US federal holiday dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hour_angle(ts) -> Column:
    return F.lit(2 * math.pi) * F.hour(ts) / 24


def weekday_angle(ts) -> Column:
    return F.lit(2 * math.pi) * F.weekday(ts) / 7


def cyclical(ts) -> dict[str, Column]:
    h, d = hour_angle(ts), weekday_angle(ts)
    return {"hour_sin": F.sin(h), "hour_cos": F.cos(h), "dow_sin": F.sin(d), "dow_cos": F.cos(d)}


def calendar_columns(ts) -> dict[str, Column]:
    return {
        "hour": F.hour(ts), "dow": F.weekday(ts), "month": F.month(ts), "doy": F.dayofyear(ts),
        "is_weekend": F.weekday(ts) >= 5, **cyclical(ts),
    }


# Month and day; month, weekday (Monday is 0) and the days of the
# month on which the nth such weekday can fall.
FIXED_HOLIDAYS = {"New Year": (1, 1), "Juneteenth": (6, 19), "Independence": (7, 4), "Veterans": (11, 11), "Christmas": (12, 25)}
FLOATING_HOLIDAYS = {
    "King": (1, 0, 15, 21), "Washington": (2, 0, 15, 21), "Memorial": (5, 0, 25, 31), "Labor": (9, 0, 1, 7), "Columbus": (10, 0, 8, 14), "Thanksgiving": (11, 3, 22, 28),
}
JUNETEENTH_SINCE = 2021


def _fixed(day: Column) -> Column:
    out = F.lit(False)
    for name, (m, d) in FIXED_HOLIDAYS.items():
        on = (F.month(day) == m) & (F.dayofmonth(day) == d)
        out = out | (on & (F.year(day) >= JUNETEENTH_SINCE) if name == "Juneteenth" else on)
    return out


def is_holiday(ts) -> Column:
    """US federal holiday, or the weekday one on a weekend is observed on.

    A column expression: neither a join nor a pass over the data is needed.
    """
    day = F.to_date(ts)
    w = F.weekday(day)
    out = _fixed(day) | ((w == 4) & _fixed(F.date_add(day, 1))) | ((w == 0) & _fixed(F.date_sub(day, 1)))
    for m, wd, low, high in FLOATING_HOLIDAYS.values():
        out = out | ((F.month(day) == m) & (w == wd) & F.dayofmonth(day).between(low, high))
    return out


def with_holiday_flag(df: DataFrame, ts: str = "ts", name: str = "is_holiday") -> DataFrame:
    return df.withColumn(name, F.when(is_holiday(ts), 1.0).otherwise(0.0))
