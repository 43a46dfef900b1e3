"""Source queries: raw texts are built from the driver's tables, then parsed."""

from pyspark.sql import functions as F

from loadstone.functions import timeutil as tu
from loadstone.functions import weather as wx
from loadstone.operators import metrics as mt
from loadstone.operators.baseline import skill
from loadstone.plans import frames as fr
from loadstone.functions.sql import register
from loadstone.plans.registry import query
from loadstone.session import scratch_path
from loadstone.sources import feeds, files

PERIOD = "yyyy-MM-dd'T'HH"


def demand_records(spark, sf):
    """Demand feed with empty, zero and unreadable values mixed in."""
    d = fr.demand(spark, sf).filter("demand_mw IS NOT NULL")
    text = (F.when(F.col("h") % 11 == 0, "").when(F.col("h") % 13 == 0, "0").when(F.col("h") % 17 == 0, "n/a")
            .otherwise(F.col("demand_mw").cast("string")))
    period = F.date_format("ts", PERIOD).alias("period")
    rows = d.select("region", period, F.lit("D").alias("type"), text.alias("value"))
    ahead = d.filter("forecast_mw IS NOT NULL AND h % 4 <> 0").select(
        "region", period, F.lit("DF").alias("type"), F.col("forecast_mw").cast("string").alias("value"))
    return rows.unionByName(ahead)


DEMAND_FEED_SQL = """SELECT region, ts, CASE WHEN h % 11 <> 0 AND h % 13 <> 0 AND h % 17 <> 0 THEN demand_mw END AS demand_mw,
  CASE WHEN h % 4 <> 0 THEN forecast_mw END AS forecast_mw FROM demand WHERE demand_mw IS NOT NULL"""


@query("s3_demand_feed_parse", "demand", DEMAND_FEED_SQL)
def demand_feed(spark, sf):
    return feeds.parse_demand(demand_records(spark, sf))


@query("j3_day_ahead_self_join", "demand", DEMAND_FEED_SQL)
def day_ahead_join(spark, sf):
    return feeds.join_day_ahead(demand_records(spark, sf))


@query("s4_generation_feed_parse", "generation", """
SELECT region, ts, CASE WHEN hour(ts) % 3 <> 0 THEN fuel_type WHEN hour(ts) % 2 = 1 THEN 'T' || fuel_type ELSE 'unknown' END AS fuel_type,
  CASE WHEN hour(ts) <> 5 THEN generation_mw END AS generation_mw FROM generation""")
def generation_feed(spark, sf):
    g = fr.generation(spark, sf)
    h = F.hour("ts")
    return feeds.parse_generation(g.select(
        "region", F.date_format("ts", PERIOD).alias("period"),
        F.when(h % 3 != 0, F.col("fuel_type")).alias("fueltype"),
        F.when(h % 2 == 1, F.concat(F.lit("T"), "fuel_type")).alias("type_name"),
        F.when(h == 5, "null").otherwise(F.col("generation_mw").cast("string")).alias("value")))


@query("s5_interchange_feed_parse", "interchange", """
SELECT ts, CASE WHEN day(ts) <> 1 THEN from_ba ELSE '' END AS from_ba, to_ba, CASE WHEN month(ts) <> 2 THEN interchange_mw END AS interchange_mw FROM interchange""")
def interchange_feed(spark, sf):
    x = fr.interchange(spark, sf)
    return feeds.parse_interchange(x.select(
        F.date_format("ts", PERIOD).alias("period"), F.when(F.dayofmonth("ts") != 1, F.col("from_ba")).alias("fromba"),
        F.col("to_ba").alias("toba"), F.when(F.month("ts") != 2, F.format_string("%.2f", "interchange_mw")).alias("value")))


def _payload(*variables):
    hours = F.sort_array(F.collect_list(F.struct("ts", *variables)))
    return F.struct(
        F.transform(hours, lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        *[hours[v].alias(v) for v in variables]).alias("hourly")


@query("s6_weather_payload_parse", "weather", """
SELECT region, ts, temperature_2m, wind_speed_80m, CAST(NULL AS DOUBLE) AS dew_point_2m FROM weather""")
def weather_payload(spark, sf):
    docs = fr.weather(spark, sf).groupBy("region", F.to_date("ts").alias("day")).agg(
        F.to_json(F.struct(_payload("temperature_2m", "wind_speed_80m"))).alias("payload"))
    return feeds.parse_weather(docs).select("region", "ts", "temperature_2m", "wind_speed_80m", "dew_point_2m")


@query("s7_weather_points_parse", "weather", """
SELECT dense_rank() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY region) - 1 AS point_id, ts, temperature_2m, cloud_cover FROM weather""")
def weather_points(spark, sf):
    day = F.to_date("ts").alias("day")
    one = fr.weather(spark, sf).groupBy("region", day).agg(_payload("temperature_2m", "cloud_cover"))
    docs = one.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("region", "hourly"))).alias("p")).select(
        "day", F.to_json(F.transform("p", lambda x: F.struct(x["hourly"].alias("hourly")))).alias("payload"))
    return feeds.parse_weather_points(docs).select("point_id", "ts", "temperature_2m", "cloud_cover")


@query("s8_alert_feed_parse", "alerts", """
SELECT CAST(arrival AS VARCHAR) AS id, event, CASE noaa_severity WHEN 'Extreme' THEN 'critical' WHEN 'Severe' THEN 'critical' WHEN 'Moderate' THEN 'warning' ELSE 'info' END AS severity,
  noaa_severity, 'Unknown' AS urgency, least(arrival % 700, 500) AS description_chars, date_trunc('second', onset) AS onset, expires,
  'County ' || (arrival % 9) || '|Zone ' || state AS areas, state FROM alerts""", i="description_chars")
def alert_feed(spark, sf):
    a = fr.alerts(spark, sf)
    iso = "yyyy-MM-dd'T'HH:mm:ssXXX"
    props = F.struct(
        F.col("arrival").cast("string").alias("id"), F.col("event"), F.repeat(F.lit("x"), (F.col("arrival") % 700).cast("int")).alias("description"),
        F.col("noaa_severity").alias("severity"), F.date_format("onset", iso).alias("onset"), F.date_format("expires", iso).alias("expires"),
        F.concat(F.lit("County "), (F.col("arrival") % 9).cast("string"), F.lit(" ; ; Zone "), "state").alias("areaDesc"))
    docs = a.groupBy("state", F.date_trunc("hour", "onset")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(props.alias("properties"))).alias("features"))).alias("payload"))
    return feeds.parse_alerts(docs).select(
        "id", "event", "severity", "noaa_severity", "urgency", F.length("description").alias("description_chars"),
        "onset", "expires", F.array_join("areas", "|").alias("areas"), F.col("states")[0].alias("state"))


@query("s9_last_known_good", "hourly", """
SELECT region, CASE WHEN region IN ('click', 'view') THEN 1 ELSE 0 END AS source, count(*) AS n, sum(demand_mw) AS total_mw FROM hourly
WHERE region <> 'error' GROUP BY 1""", d="total_mw", i="source")
def last_known_good(spark, sf):
    h = fr.hourly(spark, sf)
    fresh = h.filter("region <> 'view'").withColumn(
        "demand_mw", F.when(~F.col("region").isin("click", "error"), F.col("demand_mw")))
    snapshot = h.withColumn("demand_mw", F.when(F.col("region") != "error", F.col("demand_mw")))
    return feeds.last_known_good([fresh, snapshot], ["region"], "demand_mw").groupBy("region", "source").agg(
        F.count("*").alias("n"), F.sum("demand_mw").alias("total_mw"))


@query("s10_window_coverage", "weather", """
SELECT region, CAST(min(ts) AS DATE) <= DATE '2024-01-02' AND CAST(max(ts) AS DATE) >= DATE '2024-01-29' AS covered
FROM weather WHERE region <> 'error' OR ts < TIMESTAMP '2024-01-20' GROUP BY region""")
def window_coverage(spark, sf):
    w = fr.weather(spark, sf).filter("region <> 'error' OR ts < '2024-01-20'")
    return feeds.covers_days(w, ["region"], "2024-01-02", "2024-01-29")


METADATA_SQL = """SELECT o_orderpriority AS region, o_orderstatus AS model, CAST(o_orderkey AS VARCHAR) AS version,
  CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS trained_at, o_totalprice / 50000 AS mape FROM orders"""


def metadata(spark, sf):
    return fr.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("region"), F.col("o_orderstatus").alias("model"), F.col("o_orderkey").cast("string").alias("version"),
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("timestamp")).alias("trained_at"),
        (F.col("o_totalprice") / 50000).alias("mape"))


@query("s11_latest_metadata", "", f"""
SELECT region, model, trained_at, version, mape FROM ({METADATA_SQL}) WHERE trained_at IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY region, model ORDER BY trained_at DESC, version DESC) = 1""", d="mape")
def latest_meta(spark, sf):
    return feeds.latest_metadata(metadata(spark, sf))


def broken(df, at, *columns):
    """Documents (of ``columns``, default all) as lines of text, those chosen by ``at`` cut off."""
    doc = F.to_json(F.struct(*(columns or df.columns)), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    return df.select(F.when(at, F.substring(doc, 1, 17)).otherwise(doc).alias("value"))


def metadata_files(spark, sf):
    """Metadata documents written as text and scanned back, some of them cut off."""
    path = scratch_path(spark, "metadata")
    m = metadata(spark, sf).withColumn("train_rows", F.lit(None).cast("long")).select("region", F.when(F.col("version").cast("long") % 89 != 0, F.col("model")).alias("model"), "version", "trained_at", "mape", "train_rows")
    broken(m, F.col("version").cast("long") % 97 == 0).write.text(path)
    return files.scan_metadata(spark, path, "*", True)


@query("s11_metadata_files", "", f"""
SELECT region, model, trained_at, version, mape FROM ({METADATA_SQL}) WHERE trained_at IS NOT NULL AND CAST(version AS BIGINT) % 97 <> 0 AND CAST(version AS BIGINT) % 89 <> 0
QUALIFY row_number() OVER (PARTITION BY region, model ORDER BY trained_at DESC, version DESC) = 1""", d="mape")
def latest_of_files(spark, sf):
    return feeds.latest_metadata(files.accepted(metadata_files(spark, sf)))


@query("s11_metadata_rejects", "", f"""
SELECT CASE WHEN CAST(version AS BIGINT) % 97 = 0 THEN 'unreadable' ELSE 'missing model' END AS reason, count(*) AS n FROM ({METADATA_SQL})
WHERE CAST(version AS BIGINT) % 97 = 0 OR CAST(version AS BIGINT) % 89 = 0 GROUP BY 1""")
def rejects_of_files(spark, sf):
    return files.rejections(metadata_files(spark, sf)).drop("files")


@query("s12_metric_export", "scored", """
UNPIVOT (SELECT region, model, avg(abs(actual - predicted)) AS mae, avg(abs(actual - predicted) / actual) * 100 AS mape, sum(abs(actual - predicted)) / sum(actual) * 100 AS wape
  FROM scored GROUP BY ALL) ON mae, mape, wape INTO NAME metric VALUE value""", d="value")
def metric_export(spark, sf):
    wide = fr.scored(spark, sf).groupBy("region", "model").agg(
        mt.mae().alias("mae"), mt.mape().alias("mape"), mt.wape().alias("wape"))
    return files.metrics_long(wide, ["mae", "mape", "wape"])


@query("s12_metric_csv", "scored", """
UNPIVOT (SELECT region, model, avg(abs(actual - predicted)) AS mae, avg(abs(actual - predicted) / actual) * 100 AS mape FROM scored GROUP BY ALL) ON mae, mape INTO NAME metric VALUE value""", d="value")
def metric_csv(spark, sf):
    """The long export written as CSV and read back."""
    path = scratch_path(spark, "metrics")
    wide = fr.scored(spark, sf).groupBy("region", "model").agg(mt.mae().alias("mae"), mt.mape().alias("mape"))
    files.write_csv(files.metrics_long(wide, ["mae", "mape"]), path)
    return files.read_csv(spark, path, "region STRING, model STRING, metric STRING, value DOUBLE")


@query("s13_export_document", "scored", """
SELECT CAST(to_json({'n_regions': CAST(count(*) AS BIGINT), 'regions': list({'region': region, 'n': n} ORDER BY region)}) AS VARCHAR) AS document
FROM (SELECT region, count(*) AS n FROM scored GROUP BY region)""")
def export_document(spark, sf):
    """One atomic document: the roll-up and its region rows, one entry a region."""
    rows = fr.scored(spark, sf).groupBy("region").agg(F.count("*").alias("n"))
    return rows.agg(F.to_json(F.struct(
        F.count("*").alias("n_regions"), F.sort_array(F.collect_list(F.struct("region", "n"))).alias("regions"))).alias("document"))


ZONES = [z for ms in feeds.SUPER_ZONES.values() for z in ms]


def zone_samples(spark, sf):
    name = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("user_id") % 11 + 1).cast("int"))
    return fr.events(spark, sf).select(name.alias("zone"), F.col("ts"), F.col("value").alias("load_mw"))


ZONE_SQL = f"SELECT ({ZONES})[user_id % 11 + 1] AS zone, date_trunc('hour', ts) AS ts, avg(value) AS load_mw FROM events GROUP BY 1, 2"


@query("s14_zonal_hourly_wide", "", f"""
PIVOT ({ZONE_SQL}) ON zone IN ({', '.join(repr(z) for z in ZONES)}) USING max(load_mw) GROUP BY ts""",
       d="|".join(f'"{z}"' for z in ZONES))
def zonal_wide(spark, sf):
    return feeds.zonal_hourly(zone_samples(spark, sf)).groupBy("ts").pivot("zone", ZONES).agg(F.max("load_mw"))


@query("s14_super_zones", "", f"""
SELECT super_zone, ts, sum(load_mw) AS load_mw FROM (SELECT *, CASE {' '.join(f"WHEN zone IN ({', '.join(repr(m) for m in ms)}) THEN '{s}'" for s, ms in feeds.SUPER_ZONES.items())} END AS super_zone
  FROM ({ZONE_SQL})) GROUP BY 1, 2 HAVING count(*) = CASE super_zone WHEN 'LOWER_HUDSON' THEN 3 ELSE 2 END""", d="load_mw")
def super_zones(spark, sf):
    return feeds.super_zones(feeds.zonal_hourly(zone_samples(spark, sf)))


@query("s15_tick_phases", "", """
SELECT date_trunc('hour', ts) AS tick, sum(sum(value)) OVER (PARTITION BY date_trunc('hour', ts)) AS elapsed_s,
  event_type AS phase, sum(value) AS total_s, count(*) AS n FROM events GROUP BY tick, event_type""", d="elapsed_s total_s")
def tick_phases(spark, sf):
    per = fr.events(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("tick"), "event_type").agg(F.sum("value").alias("total_s"), F.count("*").alias("n"))
    doc = per.groupBy("tick").agg(
        F.sum("total_s").alias("elapsed_s"),
        F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("total_s", "n")))).alias("phases"))
    path = scratch_path(spark, "ticks")
    broken(doc.unionByName(doc.filter("hour(tick) = 7")), F.lit(False)).unionByName(broken(doc, F.lit(True))).write.text(path)
    ticks = files.read_ticks(spark, path).dropDuplicates(["tick"])
    return feeds.explode_ticks(ticks)


@query("p1_utc_normalise", "", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL '330 minutes' END AS utc FROM events""")
def utc_normalise(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_id") % 2 == 0, stamp).otherwise(F.concat(stamp, F.lit("+05:30")))
    return fr.events(spark, sf).select("event_id", tu.utc(text).alias("utc"))


@query("p2_canonical_hour", "", """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S+00:00') END AS canonical FROM events""")
def canonical(spark, sf):
    text = F.when(F.col("event_id") % 10 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:00:00'Z'")).otherwise(F.lit("not a time"))
    return fr.events(spark, sf).select("event_id", tu.canonical_hour(text).alias("canonical"))


@query("p3_floor_hour", "", "SELECT event_id, date_trunc('hour', ts) AS hour_ts FROM events")
def floor_hour(spark, sf):
    return fr.events(spark, sf).select("event_id", F.date_trunc("hour", "ts").alias("hour_ts"))


def written(spark, sf):
    """The demand table written by region to the shared folder."""
    path = scratch_path(spark, "demand")
    files.write_table(fr.demand(spark, sf).select("region", "ts", "demand_mw", "forecast_mw"), path)
    return path


@query("s1_partitioned_scan", "demand", "SELECT region, ts, demand_mw, forecast_mw FROM demand WHERE region IN ('click', 'view')")
def partitioned_scan(spark, sf):
    return files.read_table(spark, written(spark, sf), files.DEMAND, ["click", "view"])


@query("s2_partitioned_sink", "demand", "SELECT region, count(*) AS n, count(demand_mw) AS known, sum(demand_mw) AS total_mw FROM demand GROUP BY region", d="total_mw")
def partitioned_sink(spark, sf):
    return files.read_table(spark, written(spark, sf), files.DEMAND).groupBy("region").agg(
        F.count("*").alias("n"), F.count("demand_mw").alias("known"), F.sum("demand_mw").alias("total_mw"))


@query("x3_composed_aggregates", "scored weather", """
WITH e AS (SELECT region, sum(abs(actual - predicted)) / sum(actual) * 100 AS wape, 1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)) AS r2, avg(abs(actual - predicted) / actual) * 100 AS mape FROM scored WHERE model = 'lag24' GROUP BY region),
b AS (SELECT region, avg(abs(actual - predicted) / actual) * 100 AS base FROM scored WHERE model = 'lag168' GROUP BY region),
w AS (SELECT region, degrees(atan2(avg(sin(radians(wind_direction_10m))), avg(cos(radians(wind_direction_10m))))) AS deg FROM weather GROUP BY region)
SELECT region, wape, r2, round(1 - mape / base, 4) AS skill, CASE WHEN deg < 0 THEN deg + 360 ELSE deg END AS mean_direction FROM e JOIN b USING (region) JOIN w USING (region)""", d="wape r2 skill mean_direction")
def composed(spark, sf):
    s = fr.scored(spark, sf)
    e = s.filter("model = 'lag24'").groupBy("region").agg(mt.wape().alias("wape"), mt.r2().alias("r2"), mt.positive_mape().alias("m"))
    b = s.filter("model = 'lag168'").groupBy("region").agg(mt.positive_mape().alias("b"))
    w = fr.weather(spark, sf).groupBy("region").agg(wx.circular_mean("wind_direction_10m").alias("mean_direction"))
    return e.join(b, "region").join(w, "region").select("region", "wape", "r2", skill(F.col("m"), F.col("b")).alias("skill"), "mean_direction")


@query("x4_spine_table_function", "hourly", """
SELECT region, unnest(generate_series(min(ts), max(ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY region""")
def spine_function(spark, sf):
    """The hour spine as a lateral table function in SQL."""
    fr.hourly(spark, sf).createOrReplaceTempView("loadstone_hourly")
    return spark.sql("""
        SELECT region, s.ts FROM (SELECT region, min(ts) AS a, max(ts) AS b FROM loadstone_hourly GROUP BY region),
        LATERAL explode(sequence(a, b + INTERVAL 24 HOURS, INTERVAL 1 HOUR)) AS s(ts)""")


@query("x4_sql_surface", "hourly scored", """
WITH n AS (SELECT region, count(*) AS n FROM hourly GROUP BY region),
s AS (SELECT region, fold, n - fold * 48 - 72 AS test_start FROM n, (SELECT unnest(generate_series(0, 11)) AS fold) WHERE n - fold * 48 - 72 >= 300),
c AS (SELECT region, count(*) FILTER (isodow(ts) >= 6) AS weekend_hours, count(*) AS spine_hours FROM (SELECT region, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY region) GROUP BY region),
e AS (SELECT region, sum(abs(actual - predicted)) FILTER (model = 'lag24') / sum(actual) FILTER (model = 'lag24') * 100 AS wape, avg(200 * abs(actual - predicted) / (actual + predicted)) AS smape,
  round(1 - avg(abs(actual - predicted) / actual * 100) FILTER (model = 'lag24') / avg(abs(actual - predicted) / actual * 100) FILTER (model = 'lag168'), 4) AS skill FROM scored GROUP BY region)
SELECT region, spine_hours, weekend_hours, (SELECT count(*) FROM s WHERE s.region = c.region) AS folds, (SELECT min(test_start) FROM s WHERE s.region = c.region) AS first_test, 81 AS scenarios, wape, smape, skill
FROM c JOIN e USING (region)""", d="wape smape skill", i="scenarios")
def sql_surface(spark, sf):
    """Spine, calendar, splits, axes and error measures from SQL text alone."""
    register(spark)
    fr.hourly(spark, sf).createOrReplaceTempView("loadstone_hourly")
    fr.scored(spark, sf).createOrReplaceTempView("loadstone_scored")
    return spark.sql("""
        WITH span AS (SELECT region, min(ts) AS a, max(ts) AS b, count(*) AS n FROM loadstone_hourly GROUP BY region),
        c AS (SELECT region, count(*) AS spine_hours, count_if(is_weekend) AS weekend_hours FROM span, LATERAL ls_calendar(a, b) GROUP BY region),
        f AS (SELECT region, count(*) AS folds, min(test_start) AS first_test FROM span, LATERAL ls_splits(n, 12, 72, 300, 48) GROUP BY region),
        e AS (SELECT region, ls_wape(sum(abs(actual - predicted)) FILTER (WHERE model = 'lag24'), sum(actual) FILTER (WHERE model = 'lag24')) AS wape, avg(ls_smape(actual, predicted)) AS smape,
            ls_skill(avg(ls_ape(actual, predicted)) FILTER (WHERE model = 'lag24'), avg(ls_ape(actual, predicted)) FILTER (WHERE model = 'lag168')) AS skill FROM loadstone_scored GROUP BY region)
        SELECT region, spine_hours, weekend_hours, coalesce(folds, 0) AS folds, first_test, (SELECT count(*) FROM ls_scenario_axes()) AS scenarios, wape, smape, skill FROM c LEFT JOIN f USING (region) JOIN e USING (region)""")
