"""Weather-delta scenarios: shifted frames, responses, envelopes, interpolation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.functions import pricing as pr
from loadstone.functions import weather as wx
from loadstone.functions.calendar import hour_angle

# Fixed values.
TEMP_F = (-20.0, -15.0, -10.0, -5.0, 0.0, 5.0, 10.0, 15.0, 20.0)
WIND_MPH = (-10.0, 0.0, 10.0)
SOLAR_WM2 = (-200.0, 0.0, 200.0)
MIN_FACTOR, MAX_FACTOR = 0.6, 1.7
AXES = {"temp_f": TEMP_F, "wind_mph": WIND_MPH, "solar_wm2": SOLAR_WM2}
PART_ROWS = 1 << 14  # requests of one key that meet one copy of its curves
AXIS_COLUMN = {"temp_f": "temperature_2m", "wind_mph": "wind_speed_80m", "solar_wm2": "shortwave_radiation"}


def heuristic(temp: Column, wind: Column, solar: Column) -> Column:
    return F.lit(1.0) + temp / 5.0 * 0.025 + solar * 0.00015 + wind * 0.0005


def cells(axes: dict[str, Sequence[float]] = AXES) -> Column:
    """Array of every axis combination, a fixed 81 entries."""
    combos = [(t, w, s) for t in axes["temp_f"] for w in axes["wind_mph"] for s in axes["solar_wm2"]]
    return F.array(*[F.struct(F.lit(t).alias("temp_f"), F.lit(w).alias("wind_mph"), F.lit(s).alias("solar_wm2")) for t, w, s in combos])


def shifted(future: DataFrame, axes: dict[str, Sequence[float]] = AXES) -> DataFrame:
    """Future rows times the axis cells, weather shifted and derived features recomputed."""
    x = future.select("*", F.inline(cells(axes)))
    t = F.col("temperature_2m") + F.col("temp_f")
    wind = wx.at_least(F.col("wind_speed_80m") + F.col("wind_mph"), 0.0)
    sun = wx.at_least(F.col("shortwave_radiation") + F.col("solar_wm2"), 0.0)
    new = {"temperature_2m": t, "wind_speed_80m": wind, "shortwave_radiation": sun}
    if "temperature_deviation" in future.columns:
        new["temperature_deviation"] = F.col("temperature_deviation") + F.col("temp_f")
    y = x.select(*[new[c].alias(c) if c in new else F.col(c) for c in x.columns])
    return y.select(
        "*", wx.cdd("temperature_2m").alias("cooling_degree_days"), wx.hdd("temperature_2m").alias("heating_degree_days"),
        wx.wind_power("wind_speed_80m").alias("wind_power_estimate"), wx.solar_factor("shortwave_radiation").alias("solar_capacity_factor"),
        (F.col("temperature_2m") * F.sin(hour_angle("ts"))).alias("temp_x_hour"))


def factors(predicted: DataFrame, keys: Sequence[str] = ("region",), step: str = "step") -> DataFrame:
    """Ratio to the zero-delta cell; a cell that leaves the band falls back to one.

    ``predicted`` holds key, step, the three axis columns and predicted.
    """
    axis = list(AXES)
    base = predicted.filter("temp_f = 0 AND wind_mph = 0 AND solar_wm2 = 0").select(*keys, step, F.col("predicted").alias("base"))
    x = predicted.join(base, [*keys, step]).withColumn("ratio", F.try_divide(F.col("predicted"), F.col("base")))
    bad = x.groupBy(*keys, *axis).agg(
        ((F.min("ratio") < MIN_FACTOR) | (F.max("ratio") > MAX_FACTOR) | F.bool_or(F.col("ratio").isNull() | F.isnan("ratio"))).alias("implausible"))
    return x.join(bad, [*keys, *axis]).select(
        *keys, *axis, step, "base", "predicted", F.when(F.col("implausible"), 1.0).otherwise(F.round("ratio", 5)).alias("factor"), "implausible")


def impact(predicted: DataFrame, capacity: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Peak, price and headroom consequences per cell."""
    j = predicted.join(capacity.select("region", "capacity_mw"), "region")
    d = F.col("predicted") - F.col("base")
    head = pr.headroom_pct("predicted", "capacity_mw")
    return j.groupBy(*keys, *AXES).agg(
        F.max("predicted").alias("peak_demand_mw"), F.max(d).alias("peak_delta_mw"), F.avg(F.try_divide(d, F.col("base")) * 100).alias("mean_delta_pct"),
        F.avg(pr.price("predicted", "capacity_mw") - pr.price("base", "capacity_mw")).alias("mean_price_delta"), F.min(head).alias("min_headroom_pct"))


def envelope(observed: DataFrame, future: DataFrame, keys: Sequence[str] = ("region",), axes: dict = AXES) -> DataFrame:
    """Is every shifted hour inside the observed range? One row per axis value."""
    keys = list(keys)
    o = observed.groupBy(*keys).agg(*[e for a, c in AXIS_COLUMN.items() for e in (F.min(c).alias(f"olo_{a}"), F.max(c).alias(f"ohi_{a}"))])
    f = future.groupBy(*keys).agg(*[e for a, c in AXIS_COLUMN.items() for e in (F.min(c).alias(f"flo_{a}"), F.max(c).alias(f"fhi_{a}"))])
    rows = F.array(*[F.struct(
        F.lit(a).alias("axis"), F.lit(d).alias("delta"),
        F.coalesce((F.col(f"flo_{a}") + d >= F.col(f"olo_{a}")) & (F.col(f"fhi_{a}") + d <= F.col(f"ohi_{a}")), F.lit(True)).alias("in_range")) for a, vs in axes.items() for d in vs])
    return o.join(f, keys, "left").select(*keys, F.inline(rows))


def _bracket(axis: Sequence[float], v: Column) -> Column:
    """Neighbouring axis positions with their weights, clamped to the ends, zero weights out."""
    arr = F.array(*[F.lit(a) for a in axis])
    x = F.least(F.greatest(v, F.lit(axis[0])), F.lit(axis[-1]))
    lo, hi = F.array_max(F.filter(arr, lambda a: a <= x)), F.array_min(F.filter(arr, lambda a: a >= x))
    w = F.when(hi == lo, 0.0).otherwise((x - lo) / (hi - lo))
    pair = F.array(*[F.struct((F.array_position(arr, at) - 1).alias("i"), share.alias("w")) for at, share in ((lo, 1 - w), (hi, w))])
    return F.filter(pair, lambda p: p["w"] > 0)


def _corners(axes: dict) -> Column:
    """At most eight (cell number, weight) entries of a request."""
    t, w, s = (_bracket(axes[a], F.col(c)) for a, c in DELTAS.items())
    nw, ns = len(axes["wind_mph"]), len(axes["solar_wm2"])

    def cell(a, b, c):
        return F.struct(((a["i"] * nw + b["i"]) * ns + c["i"]).cast("int").alias("i"), (a["w"] * b["w"] * c["w"]).alias("w"))

    return F.flatten(F.transform(t, lambda a: F.flatten(F.transform(w, lambda b: F.transform(s, lambda c: cell(a, b, c))))))


DELTAS = {"temp_f": "temp_delta", "wind_mph": "wind_delta", "solar_wm2": "solar_delta"}


def cube(grid: DataFrame, keys: Sequence[str] = ("region",), step: str = "step", axes: dict = AXES) -> DataFrame:
    """One row per key: the curves of its cells (a fixed number) in cell order.

    Every cell has the same steps, so a curve is a plain array beside ``_steps``.
    """
    def at(a):
        return F.array_position(F.array(*[F.lit(v) for v in axes[a]]), F.col(a)) - 1

    number = (at("temp_f") * len(axes["wind_mph"]) + at("wind_mph")) * len(axes["solar_wm2"]) + at("solar_wm2")
    cell = grid.groupBy(*keys, number.alias("_i")).agg(F.sort_array(F.collect_list(F.struct(step, "factor"))).alias("_curve"))
    rows = F.sort_array(F.collect_list(F.struct("_i", F.col(f"_curve.{step}").alias("k"), F.col("_curve.factor").alias("f"))))
    return cell.groupBy(*keys).agg(rows.alias("_r")).select(*keys, F.col("_r.f").alias("_cube"), F.col("_r")[0]["k"].alias("_steps"))


def _at(i: Column) -> Column:
    """Weighted factor of a request's corners at a step position, null outside.

    The weights of the corners add up to one.
    """
    return F.aggregate("_corners", F.lit(0.0), lambda a, c: a + c["w"] * F.get(F.get(F.col("_cube"), c["i"]), i))


def _beside(requests: DataFrame, curves: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Requests beside the one wide row of their key, by a single join.

    The requests of a key are dealt out in parts of about ``PART_ROWS``, each with its copy of the
    wide row, so a key is spread over tasks. What is shuffled and sorted is narrow: a request
    meets the curves last, and no later join carries them.
    """
    keys = list(keys)
    parts = requests.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).alias("_parts"))
    number = F.coalesce("_parts", F.lit(1).cast("long"))
    part = F.pmod(F.xxhash64(*requests.columns), number).alias("_part")
    dealt = requests.join(parts, keys, "left").select(*requests.columns, part)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("_part")
    wide = curves.join(parts, keys, "left").select(*curves.columns, copies)
    return dealt.join(wide, [*keys, "_part"], how)


def interpolate(requests: DataFrame, grid: DataFrame, keys: Sequence[str] = ("region",), step: str = "step", axes: dict = AXES) -> DataFrame:
    """Trilinear factor of every step of each request.

    The cube of a region is one small row, so requests meet it by one join and are
    never shuffled for their corners.
    """
    x = _beside(requests, cube(grid, keys, step, axes), keys, "inner").withColumn("_corners", _corners(axes))
    curve = F.transform("_steps", lambda k, i: F.struct(k.alias(step), _at(i).alias("factor")))
    return x.select(*requests.columns, F.inline(curve))


def with_fallback(requests: DataFrame, grid: DataFrame, env: DataFrame, n_hours: int, keys: Sequence[str] = ("region",), step: str = "step", axes: dict = AXES) -> DataFrame:
    """Factor of every hour of a request with its source label.

    Grid curves are held at their last value past the grid's horizon; requests
    without a grid take the heuristic. A request outside the observed range (at
    its nearest axis value) is labelled as extrapolated.
    """
    keys = list(keys)
    flags = env.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "axis", F.col("delta").cast("string")), "in_range"))).alias("_env"))
    x = _beside(requests, cube(grid, keys, step, axes).join(flags, keys, "full"), keys, "left").withColumn("_corners", _corners(axes))

    def near(a, col):
        return F.array_min(F.array(*[F.struct(F.abs(F.col(col) - v).alias("d"), F.lit(v).alias("v")) for v in axes[a]]))["v"]

    inside = F.lit(True)
    for a, col in DELTAS.items():
        inside = inside & F.coalesce(F.col("_env")[F.concat_ws(":", F.lit(a), near(a, col).cast("string"))], F.lit(True))
    flat = heuristic(*[F.col(c) for c in DELTAS.values()])
    has = F.col("_cube").isNotNull()
    curve = F.transform(F.sequence(F.lit(0), F.lit(n_hours - 1)), lambda k: F.struct(
        k.alias(step), F.coalesce(_at((F.array_position("_steps", k) - 1).cast("int")), F.col("_held"), flat).alias("factor"), F.when(~has, "heuristic").when(inside, "grid").otherwise("grid_extrapolated").alias("source")))
    return x.withColumn("_held", _at(F.size("_steps") - 1)).select(*requests.columns, F.inline(curve))


def respond(frame: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Predictions of a forecaster (a function or an ML transform) for every cell at once."""
    return predict(frame)
