"""Weather tables: merge with demand, spatial aggregation, climatology, overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadstone.functions import weather as wx
from loadstone.operators.quantiles import percentiles
from loadstone.operators.series import hour_number, keep_one, rolling_mean, windowed

# Fixed values.
RECENT_DAYS = 28
MIN_RECENT_ROWS = 168
SMOOTH_DAYS = 7
MIN_SPAN_FRACTION = 0.6
SEAM_TAU_HOURS = 120.0
FORCED_FILL = ("shortwave_radiation", "direct_normal_irradiance", "diffuse_radiation", "surface_pressure", "wind_speed_120m")
CIRCULAR = ("wind_direction_10m",)
MODAL = ("weather_code",)


def merge_demand_weather(demand: DataFrame, weather: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Both sides on the hour, newest arrival of an hour kept, demand keeps its rows."""
    def hourly(df):
        floored = df.withColumn("ts", F.date_trunc("hour", "ts"))
        return keep_one(floored, ["region", "ts"], F.desc(arrival)).drop(arrival)

    return hourly(demand).join(hourly(weather), ["region", "ts"], "left")


def spatial_mean(points: DataFrame, keys: Sequence[str], n_points: int, point: str = "point_id",
                 means: Sequence[str] = (), circular: Sequence[str] = CIRCULAR, modal: Sequence[str] = MODAL) -> DataFrame:
    """Aggregate sampling points per hour; ``complete`` marks a full grid.

    Means skip nulls, directions use the circular mean, codes the mode (smallest
    on a tie).
    """
    out = points.groupBy(*keys).agg(
        (F.count_distinct(point) == n_points).alias("complete"),
        *[F.avg(c).alias(c) for c in means], *[wx.circular_mean(c).alias(c) for c in circular])
    for c in modal:
        counts = points.filter(F.col(c).isNotNull()).groupBy(*keys, c).count()
        best = counts.groupBy(*keys).agg(F.max(F.struct("count", (-F.col(c)).alias("k"))).alias("m")).select(*keys, (-F.col("m.k")).alias(c))
        out = out.join(best, list(keys), "left")
    return out


def weighted_spatial_mean(points: DataFrame, keys: Sequence[str], weight: str, means: Sequence[str], circular: Sequence[str] = ()) -> DataFrame:
    """Weighted means over the points that reported."""
    def avg(v: Column) -> Column:
        return F.try_divide(F.sum(v * F.col(weight)), F.sum(F.when(v.isNotNull(), F.col(weight))))

    def direction(c: str) -> Column:
        rad = F.radians(c)
        return F.pmod(F.degrees(F.atan2(F.sum(F.sin(rad) * F.col(weight)), F.sum(F.cos(rad) * F.col(weight)))), F.lit(360.0))

    return points.groupBy(*keys).agg(*[avg(F.col(c)).alias(c) for c in means], *[direction(c).alias(c) for c in circular])


def stitch(archive: DataFrame, forecast: DataFrame, boundary: Column, keys: Sequence[str] = ("region",), ts: str = "ts") -> DataFrame:
    """Archive up to the boundary, forecast after it; one row an hour, archive first."""
    both = archive.filter(F.col(ts) <= boundary).withColumn("_src", F.lit(0)).unionByName(
        forecast.filter(F.col(ts) > boundary).withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, [*keys, ts], F.col("_src")).drop("_src")


def composite(base: DataFrame, best: DataFrame, now: Column, variables: Sequence[str], forced: Sequence[str] = FORCED_FILL,
              keys: Sequence[str] = ("region", "ts")) -> DataFrame:
    """Overlay the better source on future hours, except forced-fill variables.

    ``overlaid`` and ``kept`` count the variables of the row.
    """
    open_vars = [v for v in variables if v not in forced]
    alt = best.select(*keys, *[F.col(v).alias(f"_n_{v}") for v in open_vars])
    j = base.join(alt, list(keys), "left")
    future = F.col(keys[-1]) > now

    def take(v):
        n = F.col(f"_n_{v}")
        return future & n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))

    taken = sum((F.when(F.coalesce(take(v), F.lit(False)), 1).otherwise(0) for v in open_vars), F.lit(0))
    return j.select(
        *[F.when(take(c), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in open_vars else F.col(c) for c in base.columns],
        taken.alias("overlaid"), F.when(future, len(open_vars) - taken).otherwise(0).alias("kept"))


def recent_climatology(history: DataFrame, cols: Sequence[str], ts: str = "ts", keys: Sequence[str] = ("region",)) -> DataFrame:
    """Mean by (hour, weekday) over the recent weeks, or all history if too thin.

    Both means come from one aggregate; which one counts is decided per series.
    """
    span = history.groupBy(*keys).agg(F.max(ts).alias("_max"))
    x = history.join(span, list(keys)).withColumn("_recent", F.col(ts) >= F.col("_max") - F.make_dt_interval(F.lit(RECENT_DAYS)))
    cells = x.groupBy(*keys, F.hour(ts).alias("hour"), F.weekday(ts).alias("dow")).agg(
        F.count_if("_recent").alias("_nr"),
        *[F.avg(F.when(F.col("_recent"), F.col(c))).alias(f"_r_{c}") for c in cols], *[F.avg(c).alias(f"_a_{c}") for c in cols])
    enough = F.sum("_nr").over(Window.partitionBy(*keys)) >= MIN_RECENT_ROWS
    return cells.withColumn("_use", enough).filter("NOT _use OR _nr > 0").select(
        *keys, "hour", "dow", *[F.when(F.col("_use"), F.col(f"_r_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) for c in cols])


def climatology_frame(history: DataFrame, future: DataFrame, cols: Sequence[str], ts: str = "ts", keys: Sequence[str] = ("region",)) -> DataFrame:
    """Future rows with the climatology cell, or the last row where a cell is missing."""
    cells = recent_climatology(history, cols, ts, keys).withColumn("_hit", F.lit(True))
    last = history.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(ts)).alias("_last"))
    j = future.withColumn("hour", F.hour(ts)).withColumn("dow", F.weekday(ts)).join(cells, [*keys, "hour", "dow"], "left").join(last, list(keys), "left")
    return j.select(*[F.col(c) for c in future.columns],
                    *[F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_last.{c}")).alias(c) for c in cols])


def normal(history: DataFrame, cols: Sequence[str], min_days: float = 0.0, ts: str = "ts", keys: Sequence[str] = ("region",)) -> DataFrame:
    """Mean by (day of year, hour) for series that span at least ``min_days``."""
    span = history.groupBy(*keys).agg(((F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))) / 86400).alias("_days")).filter(F.col("_days") >= min_days)
    kept = history.join(span.select(*keys), list(keys), "left_semi")
    return kept.groupBy(*keys, F.dayofyear(ts).alias("doy"), F.hour(ts).alias("hour")).agg(*[F.avg(c).alias(c) for c in cols])


def smooth_normal(cells: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("region",), half: int = SMOOTH_DAYS) -> DataFrame:
    """Circular mean over the neighbouring days, wrapping at the table's ends.

    Days are table rows (present days of the series), as many as the calendar has;
    a short table is left as it is. A day feeds its 2·half+1 neighbours.
    """
    days = cells.select(*keys, "doy").distinct()
    w = Window.partitionBy(*keys)
    days = days.select(*keys, "doy", (F.row_number().over(w.orderBy("doy")) - 1).alias("_d"), F.count("*").over(w).alias("_n"))
    x = cells.join(days, [*keys, "doy"])
    reach = F.when(F.col("_n") <= 2 * half + 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(-half), F.lit(half)))
    spread = x.select(*keys, "hour", "_n", F.explode(reach).alias("_k"), "_d", *cols).withColumn("_d", F.pmod(F.col("_d") + F.col("_k"), F.col("_n")))
    sm = spread.groupBy(*keys, "hour", "_d").agg(*[F.avg(c).alias(c) for c in cols])
    return sm.join(days.select(*keys, "doy", "_d"), [*keys, "_d"]).select(*keys, "doy", "hour", *cols)


def median_normal_error(history: DataFrame, tail: DataFrame, col: str, ts: str = "ts", keys: Sequence[str] = ("region",)) -> DataFrame:
    """Error on the tail of the recent mean and of the long-run (doy, hour) median."""
    recent = recent_climatology(history, [col], ts, keys).withColumnRenamed(col, "recent")
    h = history.select(*keys, F.dayofyear(ts).alias("doy"), F.hour(ts).alias("hour"), col)
    med = percentiles(h, [*keys, "doy", "hour"], {"normal": (F.col(col), 0.5)})
    x = tail.select(*keys, F.dayofyear(ts).alias("doy"), F.hour(ts).alias("hour"), F.weekday(ts).alias("dow"), col)
    j = x.join(recent, [*keys, "hour", "dow"]).join(med, [*keys, "doy", "hour"])
    ok = j.filter("recent IS NOT NULL AND normal IS NOT NULL")
    return ok.groupBy(*keys).agg(
        F.avg(F.abs(F.col("recent") - F.col(col))).alias("recent_mae"), F.avg(F.abs(F.col("normal") - F.col(col))).alias("normal_mae"), F.count("*").alias("n"))


def overlay_forecast(future: DataFrame, feed: DataFrame, history: DataFrame, variables: Sequence[str], arrival: str | None = None) -> DataFrame:
    """Feed values over climatology where present, derived features recomputed.

    The temperature deviation runs over history and future together, on haloed
    chunks of the hour number.
    """
    newest = keep_one(feed, ["region", "ts"], F.desc(arrival)) if arrival else feed
    alt = newest.select("region", "ts", F.lit(True).alias("covered"), *[F.col(v).alias(f"_f_{v}") for v in variables])
    j = future.join(alt, ["region", "ts"], "left")
    base = j.select(*[F.coalesce(f"_f_{c}", c).alias(c) if c in variables else F.col(c) for c in future.columns],
                    F.coalesce("covered", F.lit(False)).alias("covered"))
    t = "temperature_2m"
    both = history.select("region", "ts", t, F.lit(False).alias("_future")).unionByName(base.select("region", "ts", t, F.lit(True).alias("_future")))
    dev = windowed(both.withColumn("_h", hour_number("ts")), ["region"], "_h", {
        "temperature_deviation": lambda w: F.col(t) - rolling_mean(t, w, -719, 0)}, before=719)
    dev = dev.filter("_future").select("region", "ts", "temperature_deviation")
    out = base.drop("temperature_deviation").join(dev, ["region", "ts"])
    angle = F.lit(2 * 3.141592653589793) * F.hour("ts") / 24
    return out.select(
        "*", wx.cdd(t).alias("cooling_degree_days"), wx.hdd(t).alias("heating_degree_days"),
        wx.wind_power("wind_speed_80m").alias("wind_power_estimate"), wx.solar_factor("shortwave_radiation").alias("solar_capacity_factor"),
        (F.col(t) * F.sin(angle)).alias("temp_x_hour"))


def normal_tail(future: DataFrame, cells: DataFrame, cols: Sequence[str], skip_blend: Sequence[str] = (*CIRCULAR, *MODAL),
                keys: Sequence[str] = ("region",)) -> DataFrame:
    """Normals on uncovered hours, blended from the last covered day's anomaly.

    ``future`` has a ``covered`` flag. The blend weight decays with the hours past
    the last covered one; the last covered day is a small table per series.
    """
    lut = cells.select(*keys, "doy", "hour", *[F.col(c).alias(f"_n_{c}") for c in cols])
    f = future.withColumn("doy", F.dayofyear("ts")).withColumn("hour", F.hour("ts")).join(lut, [*keys, "doy", "hour"], "left")
    now = [F.when(~F.col("covered"), F.coalesce(f"_n_{c}", c)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in future.columns]
    f = f.select(*now, "hour")
    blend = [c for c in cols if c not in skip_blend]
    if not blend:
        return f.drop("hour")
    last = future.filter("covered").groupBy(*keys).agg(F.max("ts").alias("_last"))
    day = f.filter("covered").join(last, list(keys)).filter(F.col("ts") > F.col("_last") - F.expr("INTERVAL 24 HOURS"))
    real = day.groupBy(*keys, "hour").agg(*[F.max_by(c, "ts").alias(f"_r_{c}") for c in blend])
    j = f.join(last, list(keys), "left").join(real, [*keys, "hour"], "left")
    past = (F.unix_timestamp("ts") - F.unix_timestamp("_last")) / 3600
    w = F.when(past > 0, F.exp(-past / SEAM_TAU_HOURS)).otherwise(0.0)

    def mix(c):
        r = F.col(f"_r_{c}")
        return F.when(r.isNull() | F.col("_last").isNull(), F.col(c)).otherwise(F.col(c) * (1 - w) + r * w).alias(c)

    return j.select(*[mix(c) if c in blend else F.col(c) for c in future.columns])


def forecast_accuracy(forecast: DataFrame, truth: DataFrame, leads: Sequence[int], variables: Sequence[str],
                      keys: Sequence[str] = ("region", "ts")) -> DataFrame:
    """RMSE and bias by (arm, variable, lead) of ``{variable}_previous_day{lead}`` columns."""
    cols = [f"{v}_previous_day{n}" for v in variables for n in leads]
    long = forecast.unpivot([*keys, "arm"], cols, "name", "p").select(
        *keys, "arm", F.regexp_extract("name", r"^(.*)_previous_day(\d+)$", 1).alias("variable"),
        F.regexp_extract("name", r"_previous_day(\d+)$", 1).cast("int").alias("lead_d"), "p")
    t = truth.unpivot(list(keys), list(variables), "variable", "t")
    err = F.col("p") - F.col("t")
    return long.join(t, [*keys, "variable"]).filter("p IS NOT NULL AND t IS NOT NULL").groupBy("arm", "variable", "lead_d").agg(
        F.sqrt(F.avg(F.pow(err, F.lit(2.0)))).alias("rmse"), F.avg(err).alias("bias"), F.count("*").alias("n"))


def beats_control(table: DataFrame, control: str, noise: float = 0.02) -> DataFrame:
    """Arms whose RMSE is below the control's by more than the noise, per cell."""
    base = table.filter(F.col("arm") == control).select("variable", "lead_d", F.col("rmse").alias("control_rmse"))
    gain = (F.col("control_rmse") - F.col("rmse")) / F.col("control_rmse")
    return table.filter(F.col("arm") != control).join(base, ["variable", "lead_d"]).filter("control_rmse > 0").select(
        "arm", "variable", "lead_d", gain.alias("gain"), (gain > noise).alias("beats"))
