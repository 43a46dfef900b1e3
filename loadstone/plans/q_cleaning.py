"""Cleaning queries: predicates, artifacts, gaps, conditioning, filters, replay."""

from pyspark.sql import functions as F

from loadstone.operators import cleaning as cl
from loadstone.plans import frames as fr
from loadstone.plans.registry import query

ARTIFACT_SQL = """CASE WHEN demand_mw IS NULL OR NOT demand_mw > 0 THEN true WHEN med IS NULL THEN false
  WHEN forecast_mw > 0 AND demand_mw < 0.5 * forecast_mw AND demand_mw < 0.6 * med THEN true
  WHEN demand_mw < 0.1 * med THEN true ELSE coalesce(demand_mw < 0.4 * prev AND demand_mw < 0.6 * med, false) END"""


@query("p4_real_positive", "demand", "SELECT region, ts, coalesce(demand_mw - 100 > 0, false) AS is_real FROM demand")
def real_positive(spark, sf):
    return fr.demand(spark, sf).select("region", "ts", cl.real_positive(F.col("demand_mw") - 100).alias("is_real"))


@query("p5_implausible_readings", "demand", f"""
SELECT region, ts, {ARTIFACT_SQL} AS artifact FROM (SELECT *,
  quantile_cont(demand_mw, 0.5) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS med,
  last_value(demand_mw IGNORE NULLS) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS prev FROM demand)""")
def implausible(spark, sf):
    return cl.flag_artifacts(fr.demand(spark, sf)).select("region", "ts", "artifact")


P6_SQL = f"""WITH RECURSIVE tail AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS back FROM demand),
arr AS (SELECT region, list(ts ORDER BY ts) AS tss, list(demand_mw ORDER BY ts) AS vals, list(forecast_mw ORDER BY ts) AS dfs FROM tail WHERE back <= 72 GROUP BY region),
fold AS (SELECT region, tss, vals, dfs, greatest(len(vals) - 48, 0) AS i, CAST(NULL AS DOUBLE) AS mw, CAST(NULL AS DOUBLE) AS med, CAST(NULL AS DOUBLE) AS prev, CAST(NULL AS DOUBLE) AS df, false AS hit FROM arr
  UNION ALL
  SELECT region, tss, CASE WHEN art THEN list_concat(vals[:i], [NULL], vals[i + 2:]) ELSE vals END, dfs, i + 1, demand_mw, med, prev, forecast_mw, art
  FROM (SELECT *, demand_mw > 0 AND ({ARTIFACT_SQL}) AS art FROM (SELECT region, tss, vals, dfs, i, vals[i + 1] AS demand_mw, dfs[i + 1] AS forecast_mw,
    list_aggregate(list_filter(vals[greatest(i - 23, 1):i], lambda x: x > 0), 'median') AS med,
    list_filter(vals[greatest(i - 23, 1):i], lambda x: x > 0)[-1] AS prev FROM fold WHERE i < len(vals))))
SELECT region, tss[i] AS ts, round(mw, 2) AS mw,
  CASE WHEN df > 0 AND mw < 0.5 * df THEN CAST(round(mw / df * 100) AS BIGINT) || '% of the own day-ahead forecast'
       WHEN mw < 0.1 * med THEN 'near-zero vs 24h median (' || CAST(round(mw / med * 100) AS BIGINT) || '%)'
       ELSE CAST(round((1 - mw / prev) * 100) AS BIGINT) || '% single-hour drop to ' || CAST(round(mw / med * 100) AS BIGINT) || '% of the daily median' END AS reason
FROM fold WHERE hit"""


@query("p6_artifact_log", "demand", P6_SQL)
def artifact_log(spark, sf):
    return cl.artifact_log(fr.demand(spark, sf), trailing=48)


@query("p6_artifact_coercion", "demand", P6_SQL.replace("SELECT region, tss[i] AS ts, round(mw, 2)", "SELECT d.region, d.ts, CASE WHEN x.ts IS NULL THEN d.demand_mw END AS demand_mw FROM demand d LEFT JOIN (SELECT region, tss[i] AS ts, round(mw, 2)")
       + ") x USING (region, ts)")
def artifact_coercion(spark, sf):
    d = fr.demand(spark, sf)
    return cl.coerce_artifacts(d, cl.artifact_log(d, trailing=48)).select("region", "ts", "demand_mw")


@query("p18_training_rows_without_artifacts", "demand", P6_SQL.replace("SELECT region, tss[i] AS ts, round(mw, 2)", "SELECT region, count(*) AS n FROM demand d ANTI JOIN (SELECT region, tss[i] AS ts, round(mw, 2)")
       + ") x USING (region, ts) GROUP BY region")
def without_artifacts(spark, sf):
    d = fr.demand(spark, sf)
    return cl.drop_logged(d, cl.artifact_log(d, trailing=48)).groupBy("region").agg(F.count("*").alias("n"))


def holey(spark, sf):
    """Demand with longer outages cut into it and the window widened at both ends."""
    d = fr.demand(spark, sf)
    return d.withColumn("demand_mw", F.when(~(((F.col("h") % 97) < 8) | ((F.col("h") % 41) < 3)), F.col("demand_mw")))


HOLEY = """holey AS (SELECT * REPLACE (CASE WHEN NOT (h % 97 < 8 OR h % 41 < 3) THEN demand_mw END AS demand_mw) FROM demand),
runs AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER a AS lo_h, last_value(v IGNORE NULLS) OVER a AS lo_v,
  first_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER b AS hi_h, first_value(v IGNORE NULLS) OVER b AS hi_v,
  min(h) OVER (PARTITION BY region) AS h0, max(h) OVER (PARTITION BY region) AS h1 FROM (SELECT *, {v} AS v FROM {t})
  WINDOW a AS (PARTITION BY region ORDER BY h ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY region ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
gaps AS (SELECT *, CASE WHEN v IS NULL THEN coalesce(hi_h, h1 + 1) - coalesce(lo_h, h0 - 1) - 1 ELSE 0 END AS run_len,
  CASE WHEN v IS NULL THEN h - coalesce(lo_h, h0 - 1) ELSE 0 END AS run_pos,
  CASE WHEN hi_v IS NULL THEN lo_v ELSE lo_v + (hi_v - lo_v) * (h - lo_h) / (hi_h - lo_h) END AS line FROM runs)"""


@query("p7_gap_aware_fill", "demand", "WITH " + HOLEY.format(v="demand_mw", t="holey") + """
SELECT region, ts, CASE WHEN run_len > 0 AND run_len < 6 THEN line ELSE v END AS demand_mw,
  CASE WHEN run_len = 0 THEN 'original' WHEN run_len < 6 THEN 'interpolated' ELSE 'gap' END AS data_quality FROM gaps""", d="demand_mw")
def gap_fill(spark, sf):
    return cl.fill_gaps(holey(spark, sf)).select("region", "ts", "demand_mw", "data_quality")


@query("p8_covariate_interpolation", "merged", "WITH " + HOLEY.format(v="CASE WHEN h % 50 >= 9 THEN temperature_2m END", t="merged") + """
SELECT region, ts, CASE WHEN v IS NOT NULL THEN v WHEN run_pos <= 6 THEN line END AS temperature_2m FROM gaps""", d="temperature_2m")
def covariate(spark, sf):
    m = fr.merged(spark, sf).withColumn("temperature_2m", F.when(F.col("h") % 50 >= 9, F.col("temperature_2m")))
    return cl.interpolate_covariate(m, "temperature_2m").select("region", "ts", "temperature_2m")


@query("w10_null_runs", "demand", "WITH " + HOLEY.format(v="demand_mw", t="holey") + " SELECT region, ts, run_len, run_pos FROM gaps", i="run_len run_pos")
def null_runs(spark, sf):
    return cl.null_runs(holey(spark, sf), ["region"], "h", "demand_mw").select("region", "ts", "run_len", "run_pos")


@query("p11_quality_report", "merged", """
UNPIVOT (SELECT region, count(*) AS rows, count(*) - count(demand_mw) AS null_demand_mw, count(*) - count(forecast_mw) AS null_forecast_mw,
  count(*) - count(temperature_2m) AS null_temperature_2m, count(*) - count(wind_speed_80m) AS null_wind_speed_80m,
  count(*) FILTER (demand_mw < 0) AS demand_negative, count(*) FILTER (demand_mw > 500000) AS demand_above_500000,
  count(*) FILTER (temperature_2m < -50 OR temperature_2m > 150) AS temperature_out_of_range,
  count(*) FILTER (wind_speed_80m < 0) AS wind_speed_80m_negative, count(*) FILTER (wind_speed_80m > 200) AS wind_speed_80m_above_200
  FROM (SELECT region, demand_mw - 50 AS demand_mw, forecast_mw, temperature_2m * 2 AS temperature_2m, wind_speed_80m * 4 AS wind_speed_80m FROM merged) GROUP BY region)
ON COLUMNS(* EXCLUDE region) INTO NAME "check" VALUE n""")
def quality_report(spark, sf):
    m = fr.merged(spark, sf).select("region", "ts", (F.col("demand_mw") - 50).alias("demand_mw"), "forecast_mw",
                                    (F.col("temperature_2m") * 2).alias("temperature_2m"), (F.col("wind_speed_80m") * 4).alias("wind_speed_80m"))
    return cl.quality_report(m)


@query("p12_anchor_conditioning", "demand", """
SELECT region, count(*) FILTER (swap) AS n_conditioned, avg(abs(forecast_mw - demand_mw)) FILTER (swap AND demand_mw > 0) AS mean_abs_delta,
  sum(CASE WHEN swap THEN forecast_mw ELSE demand_mw END) AS total_mw
FROM (SELECT *, region IN ('click', 'error') AND forecast_mw > 0 AND row_number() OVER (PARTITION BY region ORDER BY ts DESC) <= 3 AS swap FROM demand) GROUP BY region""",
       d="mean_abs_delta total_mw")
def anchor_conditioning(spark, sf):
    d = fr.demand(spark, sf)
    label = F.when(F.col("region").isin("click", "error"), "broken").otherwise("clean")
    classes = d.select("region").distinct().withColumn("revision_class", label)
    return cl.condition_anchor(d, classes).groupBy("region").agg(
        F.count_if("conditioned").alias("n_conditioned"), F.avg("abs_delta_mw").alias("mean_abs_delta"), F.sum("demand_mw").alias("total_mw"))


@query("p13_low_actual_filter", "scored", """
SELECT s.* EXCLUDE (lead_hours, placeholder) FROM scored s JOIN (SELECT region, model, quantile_cont(abs(actual), 0.5) AS m FROM scored GROUP BY 1, 2) USING (region, model)
WHERE abs(actual) >= 0.1 * m""")
def low_actuals(spark, sf):
    s = fr.scored(spark, sf).drop("lead_hours", "placeholder")
    return cl.drop_low_actuals(s, ["region", "model"])


@query("p14_lead_filter", "scored", """
SELECT region, model, count(*) FILTER (lead_hours IS NULL OR lead_hours <= 12) AS kept, count(*) FILTER (lead_hours > 12) AS dropped,
  count(*) FILTER (lead_hours IS NULL) AS unknown FROM scored GROUP BY ALL""")
def lead_filter(spark, sf):
    return fr.scored(spark, sf).groupBy("region", "model").agg(
        F.count_if(cl.keep_lead(12)).alias("kept"), F.count_if(F.col("lead_hours") > 12).alias("dropped"),
        F.count_if(F.col("lead_hours").isNull()).alias("unknown"))


@query("p15_trailing_window", "hourly", """
SELECT region, count(*) AS n, sum(demand_mw) AS total_mw FROM hourly JOIN (SELECT region, max(ts) AS now FROM hourly GROUP BY region) USING (region)
WHERE ts >= now - INTERVAL 168 HOUR GROUP BY region""", d="total_mw")
def trailing_window(spark, sf):
    h = fr.hourly(spark, sf)
    now = h.groupBy("region").agg(F.max("ts").alias("now"))
    return h.join(now, "region").filter(cl.within_hours(F.col("now"), 168)).groupBy("region").agg(
        F.count("*").alias("n"), F.sum("demand_mw").alias("total_mw"))


@query("p16_region_set_exclusion", "nation_load capacity", """
SELECT region, sum(demand_mw) AS demand_mw FROM nation_load WHERE region NOT IN (SELECT region FROM capacity WHERE unreliable) GROUP BY region""", d="demand_mw")
def region_exclusion(spark, sf):
    bad = fr.capacity(spark, sf).filter("unreliable").select("region")
    return fr.nation_load(spark, sf).join(bad, "region", "left_anti").groupBy("region").agg(F.sum("demand_mw").alias("demand_mw"))


@query("p20_as_of_replay", "readings", """
SELECT region, tick, count(*) AS n_hours, count(CASE WHEN cap <= tick THEN last_d END) AS n_seen, sum(CASE WHEN cap <= tick THEN last_d END) AS seen_mw
FROM (SELECT region, target_ts, min(captured_at) AS cap, arg_max(d, captured_at) AS last_d FROM readings GROUP BY 1, 2),
  (SELECT DISTINCT date_trunc('week', captured_at) + INTERVAL 60 HOUR AS tick FROM readings) t
WHERE target_ts >= date_trunc('day', tick - INTERVAL 10 DAY) AND target_ts <= date_trunc('day', tick) + INTERVAL 23 HOUR GROUP BY 1, 2""", d="seen_mw")
def as_of_replay(spark, sf):
    """One tick a week, at noon of its third day, over all weeks with captures."""
    readings = fr.readings(spark, sf)
    ticks = readings.select((F.date_trunc("week", "captured_at") + F.expr("INTERVAL 60 HOURS")).alias("tick"))
    r = readings.groupBy("region", F.col("target_ts").alias("ts")).agg(
        F.min("captured_at").alias("captured_at"), F.max_by("d", "captured_at").alias("demand_mw"))
    return cl.as_of(r.drop("captured_at"), r.drop("demand_mw"), ticks, 10).groupBy("region", "tick").agg(
        F.count("*").alias("n_hours"), F.count("demand_mw").alias("n_seen"), F.sum("demand_mw").alias("seen_mw"))


@query("p21_confidence_label", "", """
SELECT o_orderkey, CASE s WHEN 'demo' THEN 'demo' WHEN 'warming' THEN 'warming' WHEN 'error' THEN 'low' WHEN 'stale' THEN 'medium'
  ELSE CASE WHEN age > 7200 THEN 'medium' ELSE 'high' END END AS confidence
FROM (SELECT o_orderkey, (['fresh', 'stale', 'warming', 'demo', 'error'])[o_orderkey % 5 + 1] AS s, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice / 20 END AS age FROM orders)""")
def confidence(spark, sf):
    status = F.element_at(F.array(*[F.lit(s) for s in ("fresh", "stale", "warming", "demo", "error")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    age = F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice") / 20)
    return fr.table(spark, sf, "orders").select("o_orderkey", cl.confidence(status, age).alias("confidence"))


@query("p22_allow_listed_export", "scored", """
SELECT region, model, count(*) AS n, avg(abs(actual - predicted)) AS mae FROM scored WHERE model IN ('lag24', 'lag168') GROUP BY ALL""", d="mae")
def allow_listed(spark, sf):
    known, fields = ["lag24", "lag168"], ["region", "model", "actual", "predicted"]
    s = fr.scored(spark, sf).filter(F.col("model").isin(known)).select(*fields)
    return s.groupBy("region", "model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
