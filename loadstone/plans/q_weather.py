"""Weather queries: merge, spatial aggregation, climatology, overlays, accuracy."""

from pyspark.sql import functions as F

from loadstone.operators import weather as wt
from loadstone.operators.series import hours
from loadstone.plans import frames as fr
from loadstone.plans.registry import query

CUT = "2024-01-24 00:00:00"
COVER = "2024-01-26 00:00:00"
HORIZON = 168
VARS = ["temperature_2m", "wind_speed_80m", "shortwave_radiation"]


def raw_demand(spark, sf):
    """Event-time demand with repeated hours; the arrival order is the event id."""
    return fr.events(spark, sf).select(F.col("event_type").alias("region"), "ts", F.col("value").alias("demand_mw"), F.col("event_id").alias("arrival"))


@query("j1_demand_weather_merge", "weather", """
SELECT region, ts, demand_mw, temperature_2m, wind_direction_10m FROM (SELECT event_type AS region, date_trunc('hour', ts) AS ts, value AS demand_mw,
  row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS rn FROM events)
LEFT JOIN (SELECT * FROM weather WHERE hour(ts) <> 3) USING (region, ts) WHERE rn = 1""")
def merge(spark, sf):
    w = fr.weather(spark, sf).filter(F.hour("ts") != 3)
    twice = w.withColumn("arrival", F.lit(2)).unionByName(w.withColumn("temperature_2m", F.lit(0.0)).withColumn("arrival", F.lit(1)))
    return wt.merge_demand_weather(raw_demand(spark, sf), twice).select("region", "ts", "demand_mw", "temperature_2m", "wind_direction_10m")


@query("t7_keep_last", "", """
SELECT event_type AS region, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS last_value, arg_min(value, event_id) AS first_value FROM events GROUP BY 1, 2""")
def keep_last(spark, sf):
    from loadstone.operators.series import keep_one

    d = raw_demand(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    last = keep_one(d, ["region", "ts"], F.desc("arrival")).select("region", "ts", F.col("demand_mw").alias("last_value"))
    first = keep_one(d, ["region", "ts"], F.asc("arrival")).select("region", "ts", F.col("demand_mw").alias("first_value"))
    return last.join(first, ["region", "ts"])


@query("j2_demand_weather_inner", "hourly weather", """
SELECT region, count(*) AS n, corr(demand_mw, temperature_2m) AS r FROM hourly JOIN weather USING (region, ts) GROUP BY region""", d="r")
def inner(spark, sf):
    return fr.hourly(spark, sf).join(fr.weather(spark, sf), ["region", "ts"]).groupBy("region").agg(
        F.count("*").alias("n"), F.corr("demand_mw", "temperature_2m").alias("r"))


def points(spark, sf):
    """Sampling points: eight users a region, one row a point and hour."""
    return fr.events(spark, sf).groupBy(F.date_trunc("day", "ts").alias("ts"), (F.col("user_id") % 8).alias("point_id")).agg(
        F.avg("value").alias("temperature_2m"), ((F.sum("event_id") * 37) % 360).cast("double").alias("wind_direction_10m"),
        (F.sum("event_id") % 4).cast("double").alias("weather_code"), F.count("*").cast("double").alias("weight"))


POINTS = """points AS (SELECT date_trunc('day', ts) AS ts, user_id % 8 AS point_id, avg(value) AS temperature_2m, CAST((sum(event_id) * 37) % 360 AS DOUBLE) AS wind_direction_10m,
  CAST(sum(event_id) % 4 AS DOUBLE) AS weather_code, count(*) AS weight FROM events GROUP BY 1, 2)"""


@query("a11_spatial_aggregation", "", f"""WITH {POINTS},
m AS (SELECT ts, arg_max(weather_code, n * 10 - weather_code) AS weather_code FROM (SELECT ts, weather_code, count(*) AS n FROM points GROUP BY 1, 2) GROUP BY ts),
d AS (SELECT ts, count(DISTINCT point_id) = 8 AS complete, avg(temperature_2m) AS temperature_2m, degrees(atan2(avg(sin(radians(wind_direction_10m))), avg(cos(radians(wind_direction_10m))))) AS deg FROM points GROUP BY ts)
SELECT ts, complete, temperature_2m, CASE WHEN deg < 0 THEN deg + 360 ELSE deg END AS wind_direction_10m, weather_code FROM d JOIN m USING (ts)""",
       d="temperature_2m wind_direction_10m weather_code")
def spatial(spark, sf):
    return wt.spatial_mean(points(spark, sf), ["ts"], 8, means=["temperature_2m"])


@query("a12_weighted_spatial_aggregation", "", f"""WITH {POINTS}
SELECT ts, t AS temperature_2m, CASE WHEN deg < 0 THEN deg + 360 ELSE deg END AS wind_direction_10m FROM (SELECT ts, sum(temperature_2m * weight) / sum(weight) AS t,
  degrees(atan2(sum(weight * sin(radians(wind_direction_10m))), sum(weight * cos(radians(wind_direction_10m))))) AS deg FROM points GROUP BY ts)""", d="temperature_2m wind_direction_10m")
def weighted(spark, sf):
    return wt.weighted_spatial_mean(points(spark, sf), ["ts"], "weight", ["temperature_2m"], ["wind_direction_10m"])


def history(spark, sf):
    return fr.weather(spark, sf).filter(F.col("ts") < F.lit(CUT).cast("timestamp"))


def future(spark, sf):
    """Hours after the cut, one row a region and hour."""
    start = F.lit(CUT).cast("timestamp")
    return fr.hourly(spark, sf).select("region").distinct().select(
        "region", F.explode(F.sequence(start, start + hours(HORIZON - 1), F.expr("INTERVAL 1 HOUR"))).alias("ts"))


def feed(spark, sf):
    return fr.weather(spark, sf).filter(F.col("ts") < F.lit(COVER).cast("timestamp"))


HIST = f"hist AS (SELECT * FROM weather WHERE ts < TIMESTAMP '{CUT}')"
FUT = f"fut AS (SELECT region, unnest(generate_series(TIMESTAMP '{CUT}', TIMESTAMP '{CUT}' + INTERVAL {HORIZON - 1} HOUR, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT region FROM hourly))"
CLIM = "clim AS (SELECT region, hour(ts) AS hour, isodow(ts) - 1 AS dow, {} FROM hist GROUP BY 1, 2, 3)".format(", ".join(f"avg({v}) AS {v}" for v in VARS))
LAST = "last AS (SELECT region, {} FROM hist GROUP BY region)".format(", ".join(f"arg_max({v}, ts) AS {v}" for v in VARS))
FRAME = "frame AS (SELECT f.region, f.ts, {} FROM fut f LEFT JOIN clim c ON f.region = c.region AND hour(f.ts) = c.hour AND isodow(f.ts) - 1 = c.dow JOIN last l ON f.region = l.region)".format(
    ", ".join(f"CASE WHEN c.region IS NOT NULL THEN c.{v} ELSE l.{v} END AS {v}" for v in VARS))


@query("a8_recent_climatology", "weather", f"WITH {HIST}, {CLIM} SELECT * FROM clim", d=" ".join(VARS), i="hour dow")
def climatology(spark, sf):
    return wt.recent_climatology(history(spark, sf), VARS)


@query("b5_climatology_forecast", "weather hourly", f"WITH {HIST}, {FUT}, {CLIM}, {LAST}, {FRAME} SELECT * FROM frame", d=" ".join(VARS))
def climatology_forecast(spark, sf):
    return wt.climatology_frame(history(spark, sf), future(spark, sf), VARS)


OVER = "over_f AS (SELECT region, ts, w.region IS NOT NULL AS covered, {} FROM frame f LEFT JOIN (SELECT region AS r2, * FROM weather WHERE ts < TIMESTAMP '{}') w USING (region, ts))".format(
    ", ".join(f"coalesce(w.{v}, f.{v}) AS {v}" for v in VARS), COVER).replace("w.region IS NOT NULL", "w.r2 IS NOT NULL")
DEV = """dev AS (SELECT region, ts, temperature_2m - avg(temperature_2m) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN 719 PRECEDING AND CURRENT ROW) AS temperature_deviation, fu
  FROM (SELECT region, ts, temperature_2m, false AS fu FROM hist UNION ALL SELECT region, ts, temperature_2m, true FROM over_f))"""


@query("j9_forecast_weather_overlay", "weather hourly", f"""WITH {HIST}, {FUT}, {CLIM}, {LAST}, {FRAME}, {OVER}, {DEV}
SELECT region, ts, covered, {', '.join(VARS)}, temperature_deviation, greatest(0, temperature_2m - 65) AS cooling_degree_days, greatest(0, 65 - temperature_2m) AS heating_degree_days,
  CASE WHEN wind_speed_80m * 0.44704 < 3 OR wind_speed_80m * 0.44704 > 25 THEN 0 ELSE least(pow(wind_speed_80m * 0.44704 / 12.0, 3), 1) END AS wind_power_estimate,
  least(greatest(shortwave_radiation / 1000.0, 0), 1) AS solar_capacity_factor, temperature_2m * sin(2 * pi() * hour(ts) / 24) AS temp_x_hour
FROM over_f JOIN (SELECT region, ts, temperature_deviation FROM dev WHERE fu) USING (region, ts)""",
       d=" ".join(VARS) + " temperature_deviation cooling_degree_days heating_degree_days wind_power_estimate solar_capacity_factor temp_x_hour")
def overlay(spark, sf):
    base = wt.climatology_frame(history(spark, sf), future(spark, sf), VARS)
    return wt.overlay_forecast(base, feed(spark, sf), history(spark, sf), VARS)


@query("u3_history_future_deviation", "weather hourly", f"""WITH {HIST}, {FUT}, {CLIM}, {LAST}, {FRAME}, {OVER}, {DEV}
SELECT region, ts, temperature_deviation FROM dev WHERE fu""", d="temperature_deviation")
def seam_deviation(spark, sf):
    return overlay(spark, sf).select("region", "ts", "temperature_deviation")


@query("j10_best_source_composite", "weather", f"""
SELECT region, ts, CASE WHEN fu AND nt IS NOT NULL THEN nt ELSE temperature_2m END AS temperature_2m, CASE WHEN fu AND nw IS NOT NULL THEN nw ELSE wind_speed_80m END AS wind_speed_80m, shortwave_radiation,
  CASE WHEN fu THEN (nt IS NOT NULL)::INT + (nw IS NOT NULL)::INT ELSE 0 END AS overlaid, CASE WHEN fu THEN 2 - (nt IS NOT NULL)::INT - (nw IS NOT NULL)::INT ELSE 0 END AS kept
FROM (SELECT b.*, ts > TIMESTAMP '{CUT}' AS fu, n.temperature_2m + 1 AS nt, CASE WHEN hour(ts) % 2 = 0 THEN n.wind_speed_80m + 1 END AS nw
  FROM weather b LEFT JOIN (SELECT * FROM weather WHERE cloud_cover > 20) n USING (region, ts))""", d=" ".join(VARS), i="overlaid kept")
def composite(spark, sf):
    w = fr.weather(spark, sf).select("region", "ts", *VARS, "cloud_cover")
    best = w.filter("cloud_cover > 20").select(
        "region", "ts", (F.col("temperature_2m") + 1).alias("temperature_2m"),
        F.when(F.hour("ts") % 2 == 0, F.col("wind_speed_80m") + 1).alias("wind_speed_80m"), (F.col("shortwave_radiation") + 1).alias("shortwave_radiation"))
    return wt.composite(w.drop("cloud_cover"), best, F.lit(CUT).cast("timestamp"), VARS)


def years(spark, sf):
    """A multi-year daily-hour series: two readings a day over the order dates."""
    o = fr.table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 2 * 12).cast("int"))
    return o.groupBy(F.concat(F.lit("P"), (F.col("o_custkey") % 2).cast("string")).alias("region"), at.alias("ts")).agg(
        (F.sum("o_custkey") % 90).cast("double").alias("temperature_2m"))


YEARS = """years AS (SELECT 'P' || (o_custkey % 2) AS region, o_orderdate + to_hours(o_orderkey % 2 * 12) AS ts, CAST(sum(o_custkey) % 90 AS DOUBLE) AS temperature_2m FROM orders GROUP BY 1, 2),
norm AS (SELECT region, dayofyear(ts) AS doy, hour(ts) AS hour, avg(temperature_2m) AS temperature_2m FROM years GROUP BY 1, 2, 3),
days AS (SELECT region, doy, row_number() OVER (PARTITION BY region ORDER BY doy) - 1 AS d, count(*) OVER (PARTITION BY region) AS n FROM (SELECT DISTINCT region, doy FROM norm)),
smooth AS (SELECT a.region, a.doy, x.hour, avg(x.temperature_2m) AS temperature_2m FROM days a JOIN days b ON a.region = b.region AND (abs(a.d - b.d) <= 7 OR a.n - abs(a.d - b.d) <= 7)
  JOIN norm x ON x.region = b.region AND x.doy = b.doy GROUP BY 1, 2, 3)"""


@query("a9_long_run_normal", "", f"WITH {YEARS} SELECT * FROM norm", d="temperature_2m", i="doy hour")
def long_normal(spark, sf):
    return wt.normal(years(spark, sf), ["temperature_2m"], min_days=365 * 2 * wt.MIN_SPAN_FRACTION)


@query("w13_circular_doy_smoothing", "", f"WITH {YEARS} SELECT * FROM smooth", d="temperature_2m", i="doy hour")
def smoothing(spark, sf):
    return wt.smooth_normal(wt.normal(years(spark, sf), ["temperature_2m"]), ["temperature_2m"])


@query("a10_median_normal_error", "", f"""WITH {YEARS},
h AS (SELECT * FROM years WHERE ts < TIMESTAMP '1998-06-01'), t AS (SELECT * FROM years WHERE ts >= TIMESTAMP '1998-06-01'),
r AS (SELECT region, hour(ts) AS hour, isodow(ts) AS dow, avg(temperature_2m) FILTER (ts >= mx - INTERVAL 28 DAY) AS rec, avg(temperature_2m) AS al, count(*) FILTER (ts >= mx - INTERVAL 28 DAY) AS nr
  FROM h JOIN (SELECT region, max(ts) AS mx FROM h GROUP BY region) USING (region) GROUP BY 1, 2, 3),
r2 AS (SELECT region, hour, dow, CASE WHEN tot >= 168 THEN rec ELSE al END AS recent FROM (SELECT *, sum(nr) OVER (PARTITION BY region) AS tot FROM r) WHERE tot < 168 OR nr > 0),
m AS (SELECT region, dayofyear(ts) AS doy, hour(ts) AS hour, quantile_cont(temperature_2m, 0.5) AS med FROM h GROUP BY 1, 2, 3)
SELECT t.region, avg(abs(recent - temperature_2m)) AS recent_mae, avg(abs(med - temperature_2m)) AS normal_mae, count(*) AS n
FROM t JOIN r2 ON t.region = r2.region AND hour(ts) = r2.hour AND isodow(ts) = r2.dow JOIN m ON t.region = m.region AND dayofyear(ts) = m.doy AND hour(ts) = m.hour GROUP BY 1""", d="recent_mae normal_mae")
def median_normal(spark, sf):
    y, at = years(spark, sf), F.lit("1998-06-01").cast("timestamp")
    return wt.median_normal_error(y.filter(F.col("ts") < at), y.filter(F.col("ts") >= at), "temperature_2m")


NORM = "norm AS (SELECT region, dayofyear(ts) AS doy, hour(ts) AS hour, {} FROM (SELECT * FROM weather WHERE ts >= TIMESTAMP '{}' OR hour(ts) <> 4) GROUP BY 1, 2, 3)".format(
    ", ".join(f"avg({v}) AS {v}" for v in VARS), CUT)
TAIL = """inj AS (SELECT o.region, o.ts, o.covered, {}, max(CASE WHEN covered THEN o.ts END) OVER (PARTITION BY o.region) AS lastc
  FROM over_f o LEFT JOIN norm n ON o.region = n.region AND dayofyear(o.ts) = n.doy AND hour(o.ts) = n.hour),
lastday AS (SELECT region, hour(ts) AS hour, {} FROM inj WHERE covered AND ts > lastc - INTERVAL 24 HOUR GROUP BY 1, 2)""".format(
    ", ".join(f"CASE WHEN NOT covered THEN coalesce(n.{v}, o.{v}) ELSE o.{v} END AS {v}" for v in VARS), ", ".join(f"arg_max({v}, ts) AS r_{v}" for v in VARS))
BLEND = "CASE WHEN ts > lastc THEN exp(-(epoch(ts - lastc) / 3600) / 120.0) ELSE 0 END"


def tail(spark, sf):
    base = wt.climatology_frame(history(spark, sf), future(spark, sf), VARS)
    cov = base.join(feed(spark, sf).select("region", "ts", F.lit(True).alias("covered"), *[F.col(v).alias(f"_f_{v}") for v in VARS]), ["region", "ts"], "left")
    cov = cov.select("region", "ts", F.coalesce("covered", F.lit(False)).alias("covered"), *[F.coalesce(f"_f_{v}", v).alias(v) for v in VARS])
    seen = fr.weather(spark, sf).filter((F.col("ts") >= F.lit(CUT).cast("timestamp")) | (F.hour("ts") != 4))
    return cov, wt.normal(seen, VARS)


@query("j11_normal_tail", "weather hourly", f"WITH {HIST}, {FUT}, {CLIM}, {LAST}, {FRAME}, {OVER}, {NORM}, {TAIL} SELECT region, ts, covered, {', '.join(VARS)} FROM inj", d=" ".join(VARS))
def normal_tail(spark, sf):
    cov, cells = tail(spark, sf)
    return wt.normal_tail(cov, cells, VARS, skip_blend=VARS)


@query("j12_seam_blend", "weather hourly", f"""WITH {HIST}, {FUT}, {CLIM}, {LAST}, {FRAME}, {OVER}, {NORM}, {TAIL}
SELECT region, ts, covered, {', '.join(f"CASE WHEN r_{v} IS NULL THEN {v} ELSE {v} * (1 - ({BLEND})) + r_{v} * ({BLEND}) END AS {v}" for v in VARS)}
FROM (SELECT i.*, d.* EXCLUDE (region, hour) FROM inj i LEFT JOIN lastday d ON i.region = d.region AND hour(i.ts) = d.hour)""", d=" ".join(VARS))
def seam_blend(spark, sf):
    cov, cells = tail(spark, sf)
    return wt.normal_tail(cov, cells, VARS)


@query("f24_anomaly_decay", "spine", "SELECT region, ts, exp(-(h % 240) / 120.0::DOUBLE) AS weight FROM spine", d="weight")
def decay(spark, sf):
    return fr.demand(spark, sf).select("region", "ts", F.exp(-(F.col("h") % 240) / wt.SEAM_TAU_HOURS).alias("weight"))


@query("u1_archive_forecast_stitch", "weather", f"""
SELECT region, ts, CASE WHEN ts <= TIMESTAMP '{CUT}' THEN temperature_2m ELSE temperature_2m + 5 END AS temperature_2m, CASE WHEN ts <= TIMESTAMP '{CUT}' THEN 'archive' ELSE 'forecast' END AS origin
FROM weather WHERE ts > TIMESTAMP '{CUT}' OR hour(ts) <> 7""", d="temperature_2m")
def stitch(spark, sf):
    w = fr.weather(spark, sf).select("region", "ts", "temperature_2m")
    archive = w.filter(F.hour("ts") != 7).withColumn("origin", F.lit("archive"))
    forecast = w.withColumn("temperature_2m", F.col("temperature_2m") + 5).withColumn("origin", F.lit("forecast"))
    return wt.stitch(archive, forecast, F.lit(CUT).cast("timestamp"))


@query("g9_stitched_coverage", "weather", f"""
SELECT region, count(*) FILTER (ts <= TIMESTAMP '{CUT}') AS archive_rows, count(*) FILTER (ts > TIMESTAMP '{CUT}') AS forecast_rows FROM weather GROUP BY region""")
def stitched(spark, sf):
    w = fr.weather(spark, sf).select("region", "ts", "temperature_2m")
    s = wt.stitch(w.withColumn("origin", F.lit(0)), w.withColumn("origin", F.lit(1)), F.lit(CUT).cast("timestamp"))
    return s.groupBy("region").agg(F.count_if(F.col("origin") == 0).alias("archive_rows"), F.count_if(F.col("origin") == 1).alias("forecast_rows"))


def lead_arms(spark, sf):
    """Three weather forecast arms: the reading one and two days before, shifted."""
    from loadstone.operators.series import hour_number, hour_spine, windowed

    s = hour_spine(fr.weather(spark, sf).select("region", "ts", *VARS[:2]), ["region"]).withColumn("h", hour_number("ts"))
    lags = windowed(s, ["region"], "h", {f"{v}_previous_day{n}": (lambda w, v=v, n=n: F.lag(v, 24 * n).over(w)) for v in VARS[:2] for n in (1, 2)}, before=48)
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).alias("k")) for a, k in (("control", 0.0), ("arm_b", 0.5), ("arm_c", -3.0))]))
    x = lags.select("*", arms.alias("a"))
    return x.select("region", "ts", "a.arm", *[(F.col(f"{v}_previous_day{n}") + F.col("a.k") * F.col("h") % 7).alias(f"{v}_previous_day{n}") for v in VARS[:2] for n in (1, 2)])


ACC = """sp AS (SELECT region, ts, temperature_2m, wind_speed_80m, CAST(epoch(ts) / 3600 AS BIGINT) AS h FROM (SELECT region, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM weather GROUP BY region) LEFT JOIN weather USING (region, ts)),
lags AS (SELECT *, {} FROM sp WINDOW w AS (PARTITION BY region ORDER BY ts)),
acc AS (SELECT arm, variable, lead_d, sqrt(avg(pow(p - t, 2))) AS rmse, avg(p - t) AS bias, count(*) AS n FROM (
  SELECT arm, variable, lead_d, t, p + (k * h) % 7 AS p FROM (SELECT h, unnest(['control', 'arm_b', 'arm_c']) AS arm, unnest([0.0::DOUBLE, 0.5, -3.0]) AS k, t1, w1, t2, w2, temperature_2m, wind_speed_80m FROM lags),
  LATERAL (VALUES ('temperature_2m', 1, temperature_2m, t1), ('temperature_2m', 2, temperature_2m, t2), ('wind_speed_80m', 1, wind_speed_80m, w1), ('wind_speed_80m', 2, wind_speed_80m, w2)) v(variable, lead_d, t, p))
  WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2, 3)""".format(
    ", ".join(f"lag({v}, {24 * n}) OVER w AS {v[0]}{n}" for v in VARS[:2] for n in (1, 2)))


@query("j23_forecast_vs_truth_by_lead", "weather", f"WITH {ACC} SELECT * FROM acc", d="rmse bias", i="lead_d")
def accuracy(spark, sf):
    return wt.forecast_accuracy(lead_arms(spark, sf), fr.weather(spark, sf).select("region", "ts", *VARS[:2]), (1, 2), VARS[:2])


@query("a41_arms_against_control", "weather", f"""WITH {ACC}
SELECT a.arm, variable, lead_d, (c.rmse - a.rmse) / c.rmse AS gain, (c.rmse - a.rmse) / c.rmse > 0.02 AS beats FROM acc a JOIN (SELECT * FROM acc WHERE arm = 'control') c USING (variable, lead_d) WHERE a.arm <> 'control' AND c.rmse > 0""",
       d="gain", i="lead_d")
def against_control(spark, sf):
    return wt.beats_control(accuracy(spark, sf), "control")
