"""Feature queries: scalar functions, lags, rolling frames, the model table."""

from pyspark.sql import functions as F

from loadstone.functions import calendar as cal
from loadstone.functions import weather as wx
from loadstone.operators import features as ft
from loadstone.operators.series import hour_number, windowed
from loadstone.plans import frames as fr
from loadstone.plans.registry import query

CDD = "CASE WHEN temperature_2m IS NOT NULL THEN greatest(0, temperature_2m - 65) END"
HDD = "CASE WHEN temperature_2m IS NOT NULL THEN greatest(0, 65 - temperature_2m) END"
def heat_sql(t, r):
    return f"""CASE WHEN {t} < 80 THEN 0.5 * ({t} + 61.0 + ({t} - 68.0) * 1.2 + {r} * 0.094)
  ELSE -42.379 + 2.04901523 * {t} + 10.14333127 * {r} - 0.22475541 * {t} * {r} - 0.00683783 * {t} * {t} - 0.05481717 * {r} * {r}
    + 0.00122874 * {t} * {t} * {r} + 0.00085282 * {t} * {r} * {r} - 0.00000199 * {t} * {t} * {r} * {r} END"""


HEAT = heat_sql("t", "r")
WIND = """CASE WHEN wind_speed_80m * 0.44704 < 3 OR wind_speed_80m * 0.44704 > 25 THEN 0
  ELSE least(pow(wind_speed_80m * 0.44704 / 12.0, 3), 1) END"""
SOLAR = "CASE WHEN shortwave_radiation IS NOT NULL THEN least(greatest(shortwave_radiation / 1000.0, 0), 1) END"


@query("f1_degree_days", "merged", f"SELECT region, ts, {CDD} AS cdd, {HDD} AS hdd FROM merged", d="cdd hdd")
def degree_days(spark, sf):
    return fr.merged(spark, sf).select("region", "ts", wx.cdd("temperature_2m").alias("cdd"), wx.hdd("temperature_2m").alias("hdd"))


@query("f2_cooling_products", "merged",
       f"SELECT region, ts, c * c AS cdd_squared, c * relative_humidity_2m / 100 AS cdd_x_humidity FROM (SELECT *, {CDD} AS c FROM merged)",
       d="cdd_squared cdd_x_humidity")
def cooling_products(spark, sf):
    c = wx.cdd("temperature_2m")
    return fr.merged(spark, sf).select(
        "region", "ts", F.pow(c, F.lit(2.0)).alias("cdd_squared"), (c * F.col("relative_humidity_2m") / 100).alias("cdd_x_humidity"))


@query("f3_heat_index", "merged",
       f"SELECT region, ts, {HEAT} AS heat_index FROM (SELECT region, ts, temperature_2m AS t, least(greatest(relative_humidity_2m, 0), 100) AS r FROM weather)",
       d="heat_index")
def heat_index(spark, sf):
    return fr.weather(spark, sf).select("region", "ts", wx.heat_index("temperature_2m", "relative_humidity_2m").alias("heat_index"))


@query("f4_wind_power", "weather", f"SELECT region, ts, {WIND} AS wind_power FROM weather", d="wind_power")
def wind_power(spark, sf):
    return fr.weather(spark, sf).select("region", "ts", wx.wind_power("wind_speed_80m").alias("wind_power"))


@query("f5_solar_factor", "merged", f"SELECT region, ts, {SOLAR} AS solar_factor FROM merged", d="solar_factor")
def solar_factor(spark, sf):
    return fr.merged(spark, sf).select("region", "ts", wx.solar_factor("shortwave_radiation").alias("solar_factor"))


@query("f6_cyclical_time", "hourly",
       """SELECT region, ts, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
       sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos FROM hourly""",
       d="hour_sin hour_cos dow_sin dow_cos")
def cyclical_time(spark, sf):
    return fr.hourly(spark, sf).select("region", "ts", *[c.alias(n) for n, c in cal.cyclical("ts").items()])


HOLIDAY_SQL = """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
near AS (SELECT day, k, CAST(day + k * INTERVAL 1 DAY AS DATE) AS x FROM days, (VALUES (-1), (0), (1)) s(k)),
hit AS (SELECT DISTINCT day FROM near WHERE
  ((month(x) = 1 AND day(x) = 1) OR (month(x) = 6 AND day(x) = 19 AND year(x) >= 2021) OR (month(x) = 7 AND day(x) = 4)
    OR (month(x) = 11 AND day(x) = 11) OR (month(x) = 12 AND day(x) = 25))
  AND (k = 0 OR (k = 1 AND isodow(x) = 6) OR (k = -1 AND isodow(x) = 7))
  UNION SELECT day FROM days WHERE
  (isodow(day) = 1 AND ((month(day) IN (1, 2) AND day(day) BETWEEN 15 AND 21) OR (month(day) = 5 AND day(day) > 24)
    OR (month(day) = 9 AND day(day) <= 7) OR (month(day) = 10 AND day(day) BETWEEN 8 AND 14)))
  OR (isodow(day) = 4 AND month(day) = 11 AND day(day) BETWEEN 22 AND 28))
SELECT days.day, CASE WHEN hit.day IS NOT NULL THEN 1.0 ELSE 0.0 END AS is_holiday FROM days LEFT JOIN hit USING (day)"""


@query("f7_holiday_flag", "", HOLIDAY_SQL, d="is_holiday")
def holiday_flag(spark, sf):
    days = fr.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return cal.with_holiday_flag(days, "day")


@query("f8_temp_hour_interaction", "merged",
       "SELECT region, ts, temperature_2m * sin(2 * pi() * hour(ts) / 24) AS temp_x_hour FROM merged", d="temp_x_hour")
def temp_hour(spark, sf):
    return fr.merged(spark, sf).select("region", "ts", (F.col("temperature_2m") * F.sin(cal.hour_angle("ts"))).alias("temp_x_hour"))


W = "WINDOW w AS (PARTITION BY region ORDER BY h)"


@query("w1_point_lags", "spine",
       f"SELECT region, ts, {', '.join(f'lag(demand_mw, {n}) OVER w AS demand_lag_{n}h' for n in ft.LAGS)} FROM spine {W}")
def point_lags(spark, sf):
    return windowed(fr.demand(spark, sf), ["region"], "h", ft.lag_columns(), before=168).select(
        "region", "ts", *ft.lag_columns())


@query("w2_ramp_rate", "spine", f"SELECT region, ts, lag(demand_mw, 1) OVER w - lag(demand_mw, 2) OVER w AS ramp_rate FROM spine {W}", d="ramp_rate")
def ramp_rate(spark, sf):
    return windowed(fr.demand(spark, sf), ["region"], "h", {
        "ramp_rate": lambda w: F.lag("demand_mw", 1).over(w) - F.lag("demand_mw", 2).over(w)}, before=2).select("region", "ts", "ramp_rate")


ROLL_SQL = ", ".join(
    f"{fn}(demand_mw) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS demand_roll_{n}h_{s}"
    for n in ft.ROLLS for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
ROLL_D = " ".join(f"demand_roll_{n}h_{s}" for n in ft.ROLLS for s in ("mean", "std", "min", "max"))


@query("w3_prior_rolling_stats", "spine", f"SELECT region, ts, {ROLL_SQL} FROM spine", d=ROLL_D)
def prior_rolling(spark, sf):
    return windowed(fr.demand(spark, sf), ["region"], "h", ft.roll_columns(), before=168).select("region", "ts", *ft.roll_columns())


AR_SQL = f"""SELECT region, ts, {', '.join(f'lag(demand_mw, {n}) OVER w AS demand_lag_{n}h' for n in ft.LAGS)},
  lag(demand_mw, 1) OVER w - lag(demand_mw, 2) OVER w AS ramp_rate, {ROLL_SQL} FROM spine {W}"""
DERIVED_SQL = """demand_lag_1h - demand_lag_3h AS demand_momentum_short, demand_lag_1h - demand_lag_24h AS demand_momentum_long,
  demand_lag_24h / CASE WHEN demand_roll_24h_mean IS NOT NULL THEN greatest(demand_roll_24h_mean, 1) END AS demand_ratio_24h,
  demand_lag_168h / CASE WHEN demand_roll_168h_mean IS NOT NULL THEN greatest(demand_roll_168h_mean, 1) END AS demand_ratio_168h"""
DERIVED_D = "demand_momentum_short demand_momentum_long demand_ratio_24h demand_ratio_168h"


@query("w4_momentum_ratio", "spine", f"SELECT region, ts, {DERIVED_SQL} FROM ({AR_SQL})", d=DERIVED_D)
def momentum_ratio(spark, sf):
    return ft.autoregressive(fr.demand(spark, sf)).select("region", "ts", *ft.DERIVED)


@query("w5_temperature_deviation", "merged",
       """SELECT region, ts, temperature_2m - avg(temperature_2m) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 719 PRECEDING AND CURRENT ROW)
       AS temperature_deviation FROM merged""", d="temperature_deviation")
def temperature_deviation(spark, sf):
    return ft.weather_features(fr.merged(spark, sf)).select("region", "ts", "temperature_deviation")


@query("w6_cdd_accumulation", "merged",
       f"""SELECT region, ts, avg(c) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS cdd_accum_24h,
       avg(c) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) AS cdd_accum_72h
       FROM (SELECT *, {CDD} AS c FROM merged)""", d="cdd_accum_24h cdd_accum_72h")
def cdd_accumulation(spark, sf):
    return ft.weather_features(fr.merged(spark, sf)).select("region", "ts", "cdd_accum_24h", "cdd_accum_72h")


def _range_sql():
    out = [f"max(demand_mw) OVER (PARTITION BY region ORDER BY h RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING) AS demand_lag_{n}h" for n in (1, 2, 3, 24, 168)]
    for n in ft.ROLLS:
        o = f"OVER (PARTITION BY region ORDER BY h RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out += [f"avg(demand_mw) {o} AS demand_roll_{n}h_mean",
                f"CASE WHEN count(demand_mw) {o} = 1 THEN 0.0 ELSE stddev_samp(demand_mw) {o} END AS demand_roll_{n}h_std",
                f"min(demand_mw) {o} AS demand_roll_{n}h_min", f"max(demand_mw) {o} AS demand_roll_{n}h_max"]
    return ", ".join(out)


SNAP = [*[f"demand_lag_{n}h" for n in ft.LAGS], "ramp_rate", *ROLL_D.split(), *DERIVED_D.split()]


@query("w7_temporal_snapshot", "hourly",
       f"""SELECT region, ts, {', '.join(f'demand_lag_{n}h' for n in ft.LAGS)}, demand_lag_1h - demand_lag_2h AS ramp_rate,
       {', '.join(ROLL_D.split())}, {DERIVED_SQL} FROM (SELECT region, ts, {_range_sql()}
       FROM (SELECT *, CAST(epoch(ts) / 3600 AS BIGINT) AS h FROM hourly))""", d="ramp_rate " + ROLL_D + " " + DERIVED_D)
def temporal(spark, sf):
    return ft.temporal_snapshot(fr.hourly(spark, sf).withColumn("h", hour_number("ts"))).select("region", "ts", *SNAP)


@query("w8_absent_hour_imputation", "spine", """
SELECT region, ts, demand_mw, coalesce(demand_mw,
  CASE WHEN hi_h - lo_h - 1 <= 6 THEN lo_v + (hi_v - lo_v) * (h - lo_h) / (hi_h - lo_h) END,
  d1, d2, d3, d4, d5, d6, d7) AS imputed_mw
FROM (SELECT *,
  last_value(CASE WHEN demand_mw IS NOT NULL THEN h END IGNORE NULLS) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo_h,
  last_value(demand_mw IGNORE NULLS) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo_v,
  first_value(CASE WHEN demand_mw IS NOT NULL THEN h END IGNORE NULLS) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi_h,
  first_value(demand_mw IGNORE NULLS) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi_v,
  """ + ", ".join(f"lag(demand_mw, {24 * k}) OVER (PARTITION BY region ORDER BY h) AS d{k}" for k in range(1, 8)) + " FROM spine)",
       d="imputed_mw")
def absent_hours(spark, sf):
    return ft.impute_hours(fr.demand(spark, sf)).select("region", "ts", "demand_mw", "imputed_mw")


EXO_IN = ft.WEATHER_INPUTS
EXO = [*EXO_IN, *ft.WEATHER_DERIVED, "temp_x_hour"]


def _fill(c):
    o = "OVER (PARTITION BY region ORDER BY h ROWS BETWEEN"
    return (f"coalesce(last_value({c} IGNORE NULLS) {o} UNBOUNDED PRECEDING AND CURRENT ROW),"
            f" first_value({c} IGNORE NULLS) {o} CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0)")


@query("p9_impute_exogenous", "merged", f"SELECT region, ts, {', '.join(f'{_fill(c)} AS {c}' for c in EXO_IN)} FROM merged", d=" ".join(EXO_IN))
def impute_exo(spark, sf):
    return ft.impute_exogenous(fr.merged(spark, sf), EXO_IN).select("region", "ts", *EXO_IN)


FEATURES_SQL = f"""WITH base AS (SELECT *, {CDD} AS cooling_degree_days, {HDD} AS heating_degree_days,
  {heat_sql('temperature_2m', 'least(greatest(relative_humidity_2m, 0), 100)')} AS heat_index,
  CASE WHEN wind_speed_80m IS NOT NULL THEN {WIND} END AS wind_power_estimate, {SOLAR} AS solar_capacity_factor FROM merged),
wide AS (SELECT *, temperature_2m - avg(temperature_2m) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 719 PRECEDING AND CURRENT ROW) AS temperature_deviation,
  avg(cooling_degree_days) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS cdd_accum_24h,
  avg(cooling_degree_days) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) AS cdd_accum_72h,
  cooling_degree_days * cooling_degree_days AS cdd_squared, cooling_degree_days * relative_humidity_2m / 100 AS cdd_x_humidity,
  temperature_2m * sin(2 * pi() * hour(ts) / 24) AS temp_x_hour,
  sin(2 * pi() * hour(ts) / 24) AS hour_sin, CASE WHEN strftime(ts, '%m-%d') IN ('01-01', '01-15') THEN 1.0 ELSE 0.0 END AS is_holiday FROM base),
filled AS (SELECT region, ts, demand_mw, hour_sin, is_holiday, {', '.join(f'{_fill(c)} AS {c}' for c in EXO)} FROM wide),
ar AS (SELECT *, {DERIVED_SQL} FROM ({AR_SQL}))
SELECT filled.*, ar.* EXCLUDE (region, ts) FROM filled JOIN ar USING (region, ts)
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ft.AUTOREGRESSIVE)}"""


@query("b1_feature_table", "merged", FEATURES_SQL, d=" ".join(["hour_sin", "is_holiday", *EXO, "ramp_rate", *ROLL_D.split(), *DERIVED_D.split()]))
def feature_table(spark, sf):
    return ft.feature_table(fr.merged(spark, sf)).select("region", "ts", "demand_mw", "hour_sin", "is_holiday", *EXO, *ft.AUTOREGRESSIVE)


@query("p10_drop_warmup", "spine",
       f"SELECT region, count(*) AS kept, min(ts) AS first_ts FROM (SELECT *, {DERIVED_SQL} FROM ({AR_SQL})) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ft.AUTOREGRESSIVE)} GROUP BY region")
def drop_warmup(spark, sf):
    return ft.autoregressive(fr.demand(spark, sf)).na.drop(subset=ft.AUTOREGRESSIVE).groupBy("region").agg(
        F.count("*").alias("kept"), F.min("ts").alias("first_ts"))


@query("p19_day_ahead_safe_view", "spine", f"""
SELECT region, ts, demand_lag_24h, demand_lag_168h, {', '.join(f'lag({c}, 24) OVER (PARTITION BY region ORDER BY ts) AS {c}' for c in ROLL_D.split())}
FROM ({AR_SQL})""", d=ROLL_D)
def day_ahead_safe(spark, sf):
    ar = ft.autoregressive(fr.demand(spark, sf))
    rolls = list(ft.roll_columns())
    shifted = windowed(ar, ["region"], "h", {f"_{c}": (lambda w, c=c: F.lag(c, 24).over(w)) for c in rolls}, before=24)
    return shifted.select("region", "ts", "demand_lag_24h", "demand_lag_168h", *[F.col(f"_{c}").alias(c) for c in rolls])


@query("b3_seasonal_naive_skill", "spine", """
SELECT region, count(ape) AS n, avg(ape) AS naive_mape, avg(ape_week) AS weekly_mape,
  1 - avg(ape) / avg(ape_week) AS skill, avg(ape) < avg(ape_week) AS beats
FROM (SELECT region, CASE WHEN demand_mw > 0 THEN abs(demand_mw - lag(demand_mw, 24) OVER w) / demand_mw * 100 END AS ape,
  CASE WHEN demand_mw > 0 THEN abs(demand_mw - lag(demand_mw, 168) OVER w) / demand_mw * 100 END AS ape_week
  FROM spine WINDOW w AS (PARTITION BY region ORDER BY h)) GROUP BY region""", d="naive_mape weekly_mape skill")
def seasonal_skill(spark, sf):
    """Seasonal-naive error at a day and a week, and the skill between them."""
    def ape(n):
        return lambda w: F.when(F.col("demand_mw") > 0, F.abs(F.col("demand_mw") - F.lag("demand_mw", n).over(w)) / F.col("demand_mw") * 100)
    x = windowed(fr.demand(spark, sf), ["region"], "h", {"ape": ape(24), "ape_week": ape(168)}, before=168)
    m, b = F.avg("ape"), F.avg("ape_week")
    return x.groupBy("region").agg(F.count("ape").alias("n"), m.alias("naive_mape"), b.alias("weekly_mape"),
                                   (1 - m / b).alias("skill"), (m < b).alias("beats"))
