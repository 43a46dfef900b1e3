"""Price, utilisation, stress and flow columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadstone.functions.weather import _c

# Fixed values.
BASE_PRICE = 50.0
TIER_MODERATE = 0.70
TIER_HIGH = 0.90
TIER_EMERGENCY = 1.00
EMERGENCY_MULTIPLIER = 20.0
STRESS_ELEVATED = 70
STRESS_HIGH = 85
NEUTRAL_FLOW_MW = 50.0


def price(load, capacity, base: float = BASE_PRICE) -> Column:
    """Merit-order price from utilisation tiers."""
    u = F.try_divide(_c(load), _c(capacity))
    return (
        F.when(u < TIER_MODERATE, base).when(u < TIER_HIGH, base * (1 + 2 * (u - TIER_MODERATE)))
        .when(u < TIER_EMERGENCY, base * F.exp(15 * (u - TIER_HIGH))).when(u.isNotNull(), base * EMERGENCY_MULTIPLIER))


def utilization_pct(load, capacity) -> Column:
    return F.try_divide(_c(load), _c(capacity)) * 100


def headroom_pct(load, capacity) -> Column:
    return F.try_divide(_c(capacity) - _c(load), _c(capacity)) * 100


def stress_score(load, capacity, unreliable) -> Column:
    """Utilisation capped at 100 and rounded half to even; null without a usable plate or load."""
    ok = (_c(capacity) > 0) & ~_c(unreliable) & (_c(load) > 0)
    return F.when(ok, F.bround(F.least(utilization_pct(load, capacity), F.lit(100.0)))).cast("long")


def stress_label(load, capacity, unreliable) -> Column:
    s = stress_score(load, capacity, unreliable)
    bad = ~(_c(capacity) > 0) | _c(unreliable)
    return F.when(bad, "Capacity n/a").when(s.isNull(), "Unavailable").when(s < STRESS_ELEVATED, "Normal").when(s < STRESS_HIGH, "Elevated").otherwise("High")


def flow_direction(net) -> Column:
    n = _c(net)
    return F.when(F.abs(n) < NEUTRAL_FLOW_MW, "neutral").when(n >= 0, "export").when(n < 0, "import")


def flow_text(net) -> Column:
    n = _c(net)
    return F.when(F.abs(n) < NEUTRAL_FLOW_MW, "0").otherwise(F.concat(F.when(n >= 0, "+").otherwise("-"), F.format_string("%.1f GW", F.abs(n) / 1000)))
