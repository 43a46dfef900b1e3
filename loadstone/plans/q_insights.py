"""Insight, snapshot-diff and scenario queries."""

from pyspark.sql import functions as F

from loadstone.operators import grid as gr
from loadstone.operators import insights as ins
from loadstone.operators import ranking as rk
from loadstone.operators import scenario as sc
from loadstone.operators.series import hour_number, hours
from loadstone.plans import frames as fr
from loadstone.plans.q_forecast import NAIVE, naive
from loadstone.plans.q_grid import NET, net
from loadstone.plans.registry import query

ROWS = 500
HIST = f"""x AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS k FROM hourly QUALIFY k <= {ROWS}),
w AS (SELECT region, ts, temperature_2m, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS k FROM weather QUALIFY k <= {ROWS}),
g AS (SELECT region, count(*) AS n, max(demand_mw) AS peak_mw, min(demand_mw) AS min_mw, avg(demand_mw) AS avg_mw, stddev_samp(demand_mw) AS std_mw, (list(ts ORDER BY demand_mw DESC, ts))[1] AS peak_time,
  avg(demand_mw) FILTER (isodow(ts) < 6) AS weekday_avg, avg(demand_mw) FILTER (isodow(ts) >= 6) AS weekend_avg, avg(demand_mw) FILTER (k <= 168) AS tw, avg(demand_mw) FILTER (k BETWEEN 169 AND 336) AS lw, quantile_cont(demand_mw, 0.9) AS p90 FROM x GROUP BY region),
mr AS (SELECT region, max(d) AS morning_ramp FROM (SELECT region, demand_mw - lag(demand_mw) OVER (PARTITION BY region ORDER BY ts) AS d FROM x WHERE hour(ts) BETWEEN 6 AND 10) GROUP BY region),
ab AS (SELECT region, count(*) FILTER (demand_mw > p90) AS hours_above_p90 FROM x JOIN g USING (region) GROUP BY region),
co AS (SELECT region, corr(demand_mw, temperature_2m) AS temp_corr FROM x JOIN w USING (region, k) GROUP BY region),
tp AS (SELECT g.region, temperature_2m AS temp_at_peak FROM g JOIN w ON g.region = w.region AND abs(epoch(w.ts - peak_time)) < 7200 QUALIFY row_number() OVER (PARTITION BY g.region ORDER BY abs(epoch(w.ts - peak_time)), w.ts) = 1),
hs AS (SELECT region, n, peak_mw, min_mw, avg_mw, std_mw, peak_time, (peak_mw - avg_mw) / avg_mw * 100 AS pct_above_avg, weekday_avg, weekend_avg, morning_ramp, CASE WHEN n >= 336 THEN (tw - lw) / lw * 100 END AS wow_pct, hours_above_p90, temp_corr, temp_at_peak
  FROM g LEFT JOIN mr USING (region) JOIN ab USING (region) LEFT JOIN co USING (region) LEFT JOIN tp USING (region))"""
HIST_D = "avg_mw std_mw pct_above_avg weekday_avg weekend_avg morning_ramp wow_pct temp_corr temp_at_peak"


def hist(spark, sf):
    return ins.historical_stats(fr.hourly(spark, sf), fr.weather(spark, sf), ROWS)


@query("a33_historical_stats", "hourly weather", f"WITH {HIST} SELECT * FROM hs", d=HIST_D)
def historical_stats(spark, sf):
    return hist(spark, sf)


def _rules(rows):
    return " UNION ALL ".join(f"SELECT region, '{n}' AS rule, {sev} AS severity, CAST({v} AS DOUBLE) AS value FROM {t} WHERE {on}" for t, n, on, sev, v in rows)


HR = "hr AS (" + _rules([
    ("hs", "peak_demand", "peak_mw <> 0", "'info'", "peak_mw"), ("hs", "ramp_rate", "morning_ramp > 0", "'info'", "morning_ramp"),
    ("hs", "weekday_weekend_ratio", "abs((weekday_avg - weekend_avg) / weekday_avg * 100) > 3", "'info'", "(weekday_avg - weekend_avg) / weekday_avg * 100"),
    ("hs", "hours_above_p90", f"hours_above_p90 > {ROWS} * 0.15", "'notable'", "hours_above_p90"),
    ("hs", "temp_correlation", "abs(temp_corr) > 0.4", "CASE WHEN abs(temp_corr) < 0.7 THEN 'info' ELSE 'notable' END", "temp_corr"),
    ("hs", "wow_trend", "abs(wow_pct) > 1.5", "CASE WHEN abs(wow_pct) > 5 THEN 'notable' ELSE 'info' END", "wow_pct"),
    ("hs", "demand_cv", "std_mw / avg_mw * 100 > 10", "'info'", "std_mw / avg_mw * 100")]) + ")"


@query("b25a_historical_rules", "hourly weather", f"WITH {HIST}, {HR} SELECT * FROM hr", d="value")
def historical_rules(spark, sf):
    return ins.historical_rules(hist(spark, sf), ROWS)


RELEVANT = ", ".join(f"('{rule}', '{p}', {i}, {o})" for o, (rule, ps) in enumerate(ins.RELEVANCE.items()) for i, p in enumerate(ps))


@query("t11_persona_insight_ranking", "hourly weather", f"""WITH {HIST}, {HR}
SELECT region, rule, severity, value, persona, rn AS rank FROM (SELECT hr.*, persona, row_number() OVER (PARTITION BY region, persona ORDER BY place, CASE severity WHEN 'warning' THEN 0 WHEN 'notable' THEN 1 ELSE 2 END, o) AS rn
  FROM hr JOIN (VALUES {RELEVANT}) r(rule, persona, place, o) USING (rule)) WHERE rn <= CASE persona WHEN 'data_scientist' THEN 5 ELSE 4 END""", d="value")
def persona_insights(spark, sf):
    return ins.persona_insights(historical_rules(spark, sf))


FS = """fc AS (SELECT * FROM naive WHERE lead_hours <= 168), fd AS (SELECT *, predicted - lag(predicted) OVER (PARTITION BY region ORDER BY ts) AS d FROM fc),
fs AS (SELECT region, max(predicted) AS peak_mw, min(predicted) AS min_mw, avg(predicted) AS avg_mw, max(predicted) - min(predicted) AS range_mw, (list(ts ORDER BY predicted DESC, ts))[1] AS peak_time, (list(ts ORDER BY predicted, ts))[1] AS min_time,
  max(d) AS max_ramp, (list(ts ORDER BY d DESC NULLS LAST, ts))[1] AS max_ramp_time, min(d) AS max_drop, avg(predicted) FILTER (isodow(ts) < 6) AS weekday_avg, avg(predicted) FILTER (isodow(ts) >= 6) AS weekend_avg, count(*) AS horizon,
  strftime((list(ts ORDER BY predicted DESC, ts))[1], '%A') AS peak_day FROM fd GROUP BY region)"""


def fstats(spark, sf):
    return ins.forecast_stats(naive(spark, sf).filter("lead_hours <= 168"))


@query("a34_forecast_stats", "spine", f"WITH {NAIVE}, {FS} SELECT * FROM fs", d="avg_mw range_mw max_ramp max_drop weekday_avg weekend_avg")
def forecast_stats(spark, sf):
    return fstats(spark, sf)


def event_capacity(spark, sf):
    """Capacity of the event regions: a multiple of their mean load."""
    return fr.hourly(spark, sf).groupBy("region").agg((F.avg("demand_mw") * 4).alias("capacity_mw"))


@query("b25b_forecast_rules", "spine", f"WITH {NAIVE}, {FS}, c AS (SELECT region, avg(demand_mw) * 4 AS cap FROM hourly GROUP BY region), f2 AS (SELECT * FROM fs JOIN c USING (region)) " + _rules([
    ("f2", "peak_demand", "true", "'info'", "peak_mw"), ("f2", "ramp_rate", "max_ramp > 0", "'info'", "max_ramp"),
    ("f2", "capacity_pct", "peak_mw / cap * 100 > 75", "CASE WHEN peak_mw / cap * 100 > 85 THEN 'warning' ELSE 'notable' END", "peak_mw / cap * 100"),
    ("f2", "weekday_weekend_diff", "abs((weekday_avg - weekend_avg) / weekday_avg * 100) > 3 AND horizon >= 168", "'info'", "(weekday_avg - weekend_avg) / weekday_avg * 100"),
    ("f2", "min_demand", "min_mw <> 0", "'info'", "min_mw")]), d="value")
def forecast_rules(spark, sf):
    return ins.forecast_rules(fstats(spark, sf), event_capacity(spark, sf))


BS = """per AS (SELECT region, model, avg(abs((actual - predicted) / actual)) * 100 AS mape, sqrt(avg(pow(actual - predicted, 2))) AS rmse, 1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)) AS r2, avg(actual - predicted) AS mean_bias, avg(actual) AS avg_actual,
  avg(abs(actual - predicted)) FILTER (hour(ts) BETWEEN 14 AND 18) AS peak_err, avg(abs(actual - predicted)) FILTER (hour(ts) >= 22 OR hour(ts) <= 6) AS offpeak_err FROM (SELECT * REPLACE (actual * 30 AS actual, predicted * 31 AS predicted) FROM scored) GROUP BY ALL),
bs AS (SELECT * FROM per JOIN (SELECT region, arg_min(model, mape) AS best_model, arg_max(model, mape) AS worst_model, max(mape) - min(mape) AS mape_spread FROM per GROUP BY region) USING (region))"""


def bstats(spark, sf):
    s = fr.scored(spark, sf).withColumn("actual", F.col("actual") * 30).withColumn("predicted", F.col("predicted") * 31)
    return ins.backtest_stats(s)


@query("a35_backtest_stats", "scored", f"WITH {BS} SELECT * FROM bs", d="mape rmse r2 mean_bias avg_actual peak_err offpeak_err mape_spread")
def backtest_stats(spark, sf):
    return bstats(spark, sf)


def _model_rules(rows):
    return _rules(rows).replace("SELECT region,", "SELECT region, model,")


@query("b25c_backtest_rules", "scored", f"WITH {BS} " + _model_rules([
    ("bs", "mape", "mape IS NOT NULL", "CASE WHEN mape > 12 THEN 'warning' WHEN mape > 3.5 THEN 'notable' ELSE 'info' END", "mape"), ("bs", "r2", "true", "CASE WHEN r2 > 0.95 THEN 'info' ELSE 'notable' END", "r2"),
    ("bs", "model_comparison", "best_model <> worst_model AND mape_spread > 0.3", "'info'", "mape_spread"), ("bs", "bias", "abs(mean_bias) > 50", "CASE WHEN abs(mean_bias) > 200 THEN 'warning' ELSE 'notable' END", "mean_bias"),
    ("bs", "error_by_hour", "peak_err / offpeak_err > 1.3", "'info'", "peak_err / offpeak_err"), ("bs", "rmse", "true", "'info'", "rmse")]), d="value")
def backtest_rules(spark, sf):
    return ins.backtest_rules(bstats(spark, sf), "24h")


@query("b25d_generation_rules", "generation", f"WITH {NET}, c AS (SELECT region, avg(demand_mw) * 8 AS cap FROM net GROUP BY region), f2 AS (SELECT * FROM st JOIN c USING (region)) " + _rules([
    ("f2", "renewable_pct", "renewable_pct IS NOT NULL", "CASE WHEN renewable_pct > 40 THEN 'notable' ELSE 'info' END", "renewable_pct"), ("f2", "evening_ramp", "evening_ramp > 0", "CASE WHEN evening_ramp > cap * 0.03 THEN 'warning' ELSE 'info' END", "evening_ramp"),
    ("f2", "min_net_load", "min_net / cap * 100 < 25", "CASE WHEN min_net / cap * 100 < 15 THEN 'notable' ELSE 'info' END", "min_net"), ("f2", "curtailment_hours", "peak_net > 0 AND curtailment_hours > 0", "CASE WHEN curtailment_hours > 24 THEN 'warning' ELSE 'notable' END", "curtailment_hours"),
    ("f2", "net_load_range", "(peak_net - min_net) / cap * 100 > 30", "'info'", "peak_net - min_net"), ("f2", "solar_peak_pct", "solar_peak_pct > 30", "'info'", "solar_peak_pct")]), d="value")
def generation_rules(spark, sf):
    n = net(spark, sf)
    cap = n.groupBy("region").agg((F.avg("demand_mw") * 8).alias("capacity_mw"))
    return ins.generation_rules(gr.net_load_stats(n), cap)


def capture(spark, sf, until):
    """Snapshot of every region as it stood at a time."""
    at = F.lit(until).cast("timestamp")
    h = fr.hourly(spark, sf).filter(F.col("ts") < at)
    g = h.groupBy("region").agg(F.max("demand_mw").alias("peak_mw"), F.avg(F.when(F.col("ts") >= at - hours(24), F.col("demand_mw"))).alias("avg_24h_mw"), F.avg("demand_mw").alias("forecast_peak_mw"),
                                F.count_if((F.col("ts") >= at - hours(24)) & (F.col("demand_mw") > 250)).alias("alert_count"), F.avg(F.when(F.col("ts") >= at - hours(48), F.col("demand_mw") / 4)).alias("renewable_pct"))
    s = fr.scored(spark, sf).filter((F.col("ts") < at) & (F.col("ts") >= at - hours(72))).groupBy("region", "model").agg((F.avg(F.abs(F.col("actual") - F.col("predicted")) / (F.col("actual") + 100)) * 30).alias("m"))
    m = s.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("mape"))
    status = F.when(F.col("avg_24h_mw") > 150, "fresh").otherwise("stale")
    return g.join(m, "region").withColumn("sources", F.create_map(F.lit("demand"), status, F.lit("weather"), F.lit("fresh")))


def _cap(n, at):
    return f"""{n} AS (SELECT region, max(demand_mw) AS peak, avg(demand_mw) FILTER (ts >= TIMESTAMP '{at}' - INTERVAL 24 HOUR) AS a24, avg(demand_mw) AS fp, count(*) FILTER (ts >= TIMESTAMP '{at}' - INTERVAL 24 HOUR AND demand_mw > 250) AS al,
  avg(demand_mw / 4) FILTER (ts >= TIMESTAMP '{at}' - INTERVAL 48 HOUR) AS ren FROM hourly WHERE ts < TIMESTAMP '{at}' GROUP BY region),
{n}m AS (SELECT region, model, avg(abs(actual - predicted) / (actual + 100)) * 30 AS m FROM scored WHERE ts < TIMESTAMP '{at}' AND ts >= TIMESTAMP '{at}' - INTERVAL 72 HOUR GROUP BY ALL)"""


P0, P1 = "2024-01-12", "2024-01-25"
DIFF = f"""{_cap('o', P0)}, {_cap('n', P1)},
j AS (SELECT o.region, (n.peak - o.peak) / o.peak * 100 AS dp, (n.a24 - o.a24) / o.a24 * 100 AS da, (n.fp - o.fp) / o.fp * 100 AS df, n.al - o.al AS more, n.al AS nal, n.ren - o.ren AS pp, n.ren AS nren, CASE WHEN o.a24 > 150 THEN 'fresh' ELSE 'stale' END AS os, CASE WHEN n.a24 > 150 THEN 'fresh' ELSE 'stale' END AS ns FROM o JOIN n USING (region)),
ch AS (SELECT region, 1 AS ord, 'demand' AS category, 'peak' AS item, CASE WHEN abs(dp) > 10 THEN 'notable' ELSE 'info' END AS severity, dp AS value FROM j WHERE abs(dp) > 5
  UNION ALL SELECT region, 2, 'demand', 'average', 'info', da FROM j WHERE abs(da) > 5 UNION ALL SELECT region, 3, 'forecast', 'peak', 'notable', df FROM j WHERE abs(df) > 5
  UNION ALL SELECT region, 4, 'alerts', 'count', CASE WHEN more > 0 THEN 'warning' ELSE 'info' END, more FROM j WHERE more > 0 OR (more < 0 AND nal = 0) UNION ALL SELECT region, 5, 'generation', 'renewable share', 'info', nren FROM j WHERE abs(pp) > 3
  UNION ALL SELECT region, 6, 'models', model, CASE WHEN nm.m > om.m THEN 'warning' ELSE 'info' END, nm.m FROM om JOIN nm USING (region, model) WHERE abs(nm.m - om.m) > 2
  UNION ALL SELECT region, 7, 'data', 'demand', CASE WHEN ns = 'stale' THEN 'warning' ELSE 'info' END, NULL FROM j WHERE os <> ns)"""


@query("b23_snapshot_diff", "hourly scored", f"WITH {DIFF} SELECT * FROM ch", d="value", i="ord")
def snapshot_diff(spark, sf):
    return ins.snapshot_diff(capture(spark, sf, P0), capture(spark, sf, P1))


CHANGE_REL = ", ".join(f"('{c}', '{p}')" for c, ps in ins.CHANGE_RELEVANCE.items() for p in ps)


@query("b23_persona_changes", "hourly scored", f"""WITH {DIFF}
SELECT region, ord, category, item, severity, value, persona, rn AS rank FROM (SELECT ch.*, persona, row_number() OVER (PARTITION BY region, persona ORDER BY CASE severity WHEN 'warning' THEN 0 WHEN 'notable' THEN 1 ELSE 2 END, ord, item) AS rn FROM ch JOIN (VALUES {CHANGE_REL}) r(category, persona) USING (category)) WHERE rn <= 5""",
       d="value", i="ord")
def persona_changes(spark, sf):
    return ins.persona_changes(snapshot_diff(spark, sf))


# -- scenarios -----------------------------------------------------------------

START = "2024-01-25"


def future(spark, sf):
    """One day of weather per region with the hour's step and a deviation column."""
    at = F.lit(START).cast("timestamp")
    w = fr.weather(spark, sf).filter((F.col("ts") >= at) & (F.col("ts") < at + hours(24)))
    return w.select("region", "ts", (hour_number("ts") % 24).cast("int").alias("step"), "temperature_2m", "wind_speed_80m", "shortwave_radiation", (F.col("temperature_2m") - 60).alias("temperature_deviation"))


def _ax(vals, name):
    return f"(SELECT unnest([{', '.join(str(v) + '::DOUBLE' for v in vals)}]) AS {name})"


SHIFT = f"""fut AS (SELECT region, ts, CAST(epoch(ts) / 3600 AS BIGINT) % 24 AS step, temperature_2m, wind_speed_80m, shortwave_radiation, temperature_2m - 60 AS temperature_deviation FROM weather WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{START}' + INTERVAL 24 HOUR),
sh0 AS (SELECT region, ts, step, temp_f, wind_mph, solar_wm2, temperature_2m + temp_f AS temperature_2m, greatest(wind_speed_80m + wind_mph, 0) AS wind_speed_80m, greatest(shortwave_radiation + solar_wm2, 0) AS shortwave_radiation, temperature_deviation + temp_f AS temperature_deviation
  FROM fut, {_ax(sc.TEMP_F, 'temp_f')}, {_ax(sc.WIND_MPH, 'wind_mph')}, {_ax(sc.SOLAR_WM2, 'solar_wm2')}),
sh AS (SELECT *, greatest(temperature_2m - 65, 0) AS cooling_degree_days, greatest(65 - temperature_2m, 0) AS heating_degree_days,
  CASE WHEN wind_speed_80m * 0.44704 < 3 OR wind_speed_80m * 0.44704 > 25 THEN 0 ELSE least(pow(wind_speed_80m * 0.44704 / 12.0, 3), 1) END AS wind_power_estimate, least(greatest(shortwave_radiation / 1000, 0), 1) AS solar_capacity_factor,
  temperature_2m * sin(2 * pi() * hour(ts) / 24) AS temp_x_hour FROM sh0),
pr AS (SELECT region, step, temp_f, wind_mph, solar_wm2, 1000 + 15 * cooling_degree_days + 12 * heating_degree_days - 120 * wind_power_estimate - 80 * solar_capacity_factor AS predicted FROM sh),
rt AS (SELECT p.*, b.predicted AS base, p.predicted / b.predicted AS ratio FROM pr p JOIN pr b USING (region, step) WHERE b.temp_f = 0 AND b.wind_mph = 0 AND b.solar_wm2 = 0),
im AS (SELECT region, temp_f, wind_mph, solar_wm2, min(ratio) < 0.6 OR max(ratio) > 1.7 AS implausible FROM rt GROUP BY ALL),
fa AS (SELECT region, temp_f, wind_mph, solar_wm2, step, base, predicted, CASE WHEN implausible THEN 1.0 ELSE round(ratio, 5) END AS factor, implausible FROM rt JOIN im USING (region, temp_f, wind_mph, solar_wm2))"""


@query("j20_scenario_cells", "weather", f"WITH {SHIFT} SELECT region, ts, temp_f, wind_mph, solar_wm2 FROM sh0")
def scenario_cells(spark, sf):
    return future(spark, sf).select("region", "ts", F.inline(sc.cells()))


SH_COLS = "temperature_2m wind_speed_80m shortwave_radiation temperature_deviation cooling_degree_days heating_degree_days wind_power_estimate solar_capacity_factor temp_x_hour"


@query("b19_weather_delta_features", "weather", f"WITH {SHIFT} SELECT * FROM sh", d=SH_COLS)
def weather_deltas(spark, sf):
    return sc.shifted(future(spark, sf))


def response(frame):
    """A stand-in forecaster: a linear response to the derived weather features."""
    p = 1000 + 15 * F.col("cooling_degree_days") + 12 * F.col("heating_degree_days") - 120 * F.col("wind_power_estimate") - 80 * F.col("solar_capacity_factor")
    return frame.select("region", "step", *sc.AXES, p.alias("predicted"))


def grid(spark, sf):
    return sc.factors(sc.respond(sc.shifted(future(spark, sf)), response))


@query("b20_scenario_factors", "weather", f"WITH {SHIFT} SELECT * FROM fa", d="base predicted factor")
def scenario_factors(spark, sf):
    return grid(spark, sf)


@query("b20_scenario_impact", "weather", f"""WITH {SHIFT}, c AS (SELECT region, 1400.0::DOUBLE + length(region) * 100 AS cap FROM (SELECT DISTINCT region FROM fut)),
u AS (SELECT fa.*, cap, predicted / cap AS u, base / cap AS ub FROM fa JOIN c USING (region)),
p AS (SELECT *, CASE WHEN u < 0.7 THEN 50 WHEN u < 0.9 THEN 50 * (1 + 2 * (u - 0.7)) WHEN u < 1 THEN 50 * exp(15 * (u - 0.9)) ELSE 1000 END AS ps, CASE WHEN ub < 0.7 THEN 50 WHEN ub < 0.9 THEN 50 * (1 + 2 * (ub - 0.7)) WHEN ub < 1 THEN 50 * exp(15 * (ub - 0.9)) ELSE 1000 END AS pb FROM u)
SELECT region, temp_f, wind_mph, solar_wm2, max(predicted) AS peak_demand_mw, max(predicted - base) AS peak_delta_mw, avg((predicted - base) / base * 100) AS mean_delta_pct, avg(ps - pb) AS mean_price_delta, min((cap - predicted) / cap * 100) AS min_headroom_pct FROM p GROUP BY ALL""",
       d="peak_demand_mw peak_delta_mw mean_delta_pct mean_price_delta min_headroom_pct")
def scenario_impact(spark, sf):
    cap = future(spark, sf).select("region").distinct().withColumn("capacity_mw", 1400.0 + F.length("region") * 100)
    return sc.impact(grid(spark, sf), cap)


ENV = f"""ob AS (SELECT region, min(temperature_2m) AS tl, max(temperature_2m) AS th, min(wind_speed_80m) AS wl, max(wind_speed_80m) AS wh, min(shortwave_radiation) AS sl, max(shortwave_radiation) AS s_h FROM weather WHERE ts < TIMESTAMP '{START}' GROUP BY region),
fb AS (SELECT region, min(temperature_2m) AS ftl, max(temperature_2m) AS fth, min(wind_speed_80m) AS fwl, max(wind_speed_80m) AS fwh, min(shortwave_radiation) AS fsl, max(shortwave_radiation) AS fsh FROM fut GROUP BY region),
en AS (SELECT region, 'temp_f' AS axis, d AS delta, ftl + d >= tl AND fth + d <= th AS in_range FROM ob JOIN fb USING (region), {_ax(sc.TEMP_F, 'd')} UNION ALL SELECT region, 'wind_mph', d, fwl + d >= wl AND fwh + d <= wh FROM ob JOIN fb USING (region), {_ax(sc.WIND_MPH, 'd')}
  UNION ALL SELECT region, 'solar_wm2', d, fsl + d >= sl AND fsh + d <= s_h FROM ob JOIN fb USING (region), {_ax(sc.SOLAR_WM2, 'd')})"""


def env(spark, sf):
    return sc.envelope(fr.weather(spark, sf).filter(F.col("ts") < F.lit(START).cast("timestamp")), future(spark, sf))


@query("b21_envelope_flags", "weather", f"WITH {SHIFT}, {ENV} SELECT * FROM en", d="delta")
def envelope_flags(spark, sf):
    return env(spark, sf)


REGIONS = ("click", "error", "purchase", "signup", "view", "nowhere")


def requests(spark, sf):
    """One what-if request per customer."""
    k = F.col("c_custkey")
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (k % 6 + 1).cast("int"))
    return fr.table(spark, sf, "customer").select(
        k.alias("request"), region.alias("region"), ((k * 7) % 61 - 30).cast("double").alias("temp_delta"), ((k * 3) % 25 - 12).cast("double").alias("wind_delta"), ((k * 11) % 501 - 250).cast("double").alias("solar_delta"))


REQ = f"""rq AS (SELECT c_custkey AS request, ({list(REGIONS)})[c_custkey % 6 + 1] AS region, CAST((c_custkey * 7) % 61 - 30 AS DOUBLE) AS temp_delta, CAST((c_custkey * 3) % 25 - 12 AS DOUBLE) AS wind_delta, CAST((c_custkey * 11) % 501 - 250 AS DOUBLE) AS solar_delta FROM customer),
cl AS (SELECT *, least(greatest(temp_delta, -20), 20) AS t, least(greatest(wind_delta, -10), 10) AS w, least(greatest(solar_delta, -200), 200) AS s FROM rq),
ip AS (SELECT request, cl.region, temp_delta, wind_delta, solar_delta, step, sum(greatest(0, 1 - abs(t - temp_f) / 5) * greatest(0, 1 - abs(w - wind_mph) / 10) * greatest(0, 1 - abs(s - solar_wm2) / 200) * factor) AS factor
  FROM cl JOIN fa ON cl.region = fa.region AND abs(t - temp_f) < 5 AND abs(w - wind_mph) < 10 AND abs(s - solar_wm2) < 200 GROUP BY ALL)"""


@query("b22_trilinear_interpolation", "weather", f"WITH {SHIFT}, {REQ} SELECT * FROM ip", d="factor")
def trilinear(spark, sf):
    return sc.interpolate(requests(spark, sf), grid(spark, sf))


@query("b22b_factor_with_fallback", "weather", f"""WITH {SHIFT}, {REQ}, {ENV},
lst AS (SELECT request, arg_max(factor, step) AS lf FROM ip GROUP BY request),
fl AS (SELECT request, bool_and(in_range) AS inside FROM (
  SELECT request, in_range FROM rq JOIN en ON rq.region = en.region AND axis = 'temp_f' QUALIFY row_number() OVER (PARTITION BY request ORDER BY abs(delta - temp_delta), delta) = 1
  UNION ALL SELECT request, in_range FROM rq JOIN en ON rq.region = en.region AND axis = 'wind_mph' QUALIFY row_number() OVER (PARTITION BY request ORDER BY abs(delta - wind_delta), delta) = 1
  UNION ALL SELECT request, in_range FROM rq JOIN en ON rq.region = en.region AND axis = 'solar_wm2' QUALIFY row_number() OVER (PARTITION BY request ORDER BY abs(delta - solar_delta), delta) = 1) GROUP BY request)
SELECT rq.*, h.step, coalesce(ip.factor, lf, 1 + temp_delta / 5 * 0.025 + solar_delta * 0.00015 + wind_delta * 0.0005) AS factor, CASE WHEN lf IS NULL THEN 'heuristic' WHEN coalesce(inside, true) THEN 'grid' ELSE 'grid_extrapolated' END AS source
FROM rq, (SELECT unnest(generate_series(0, 29)) AS step) h LEFT JOIN (SELECT request, step, factor FROM ip) ip ON ip.request = rq.request AND ip.step = h.step LEFT JOIN lst ON lst.request = rq.request LEFT JOIN fl ON fl.request = rq.request""", d="factor")
def with_fallback(spark, sf):
    r = requests(spark, sf)
    return sc.with_fallback(r, grid(spark, sf), env(spark, sf), 30)


@query("f22_heuristic_sensitivity", "", f"WITH {REQ.split(',' + chr(10) + 'cl AS')[0]} SELECT request, 1 + temp_delta / 5 * 0.025::DOUBLE + solar_delta * 0.00015::DOUBLE + wind_delta * 0.0005::DOUBLE AS factor FROM rq", d="factor")
def heuristic(spark, sf):
    return requests(spark, sf).select("request", sc.heuristic(F.col("temp_delta"), F.col("wind_delta"), F.col("solar_delta")).alias("factor"))


# -- drivers ---------------------------------------------------------------------

CONTRIB = "SELECT region, ts, temperature_2m - 60 AS temperature_2m, 30 - wind_speed_80m AS wind_speed_80m, (shortwave_radiation - 500) / 10 AS shortwave_radiation, cloud_cover - 50.5 AS cloud_cover, relative_humidity_2m - 49.3 AS soil_moisture FROM weather"


@query("t4_top_drivers", "weather", f"""
SELECT region, ts, rank, feature, CASE feature WHEN 'temperature_2m' THEN 'Temperature' WHEN 'wind_speed_80m' THEN 'Wind Speed' WHEN 'shortwave_radiation' THEN 'Solar Radiation' WHEN 'cloud_cover' THEN 'Cloud Cover' ELSE 'Soil Moisture' END AS label, value
FROM (SELECT *, row_number() OVER (PARTITION BY region, ts ORDER BY abs(value) DESC, feature DESC) AS rank FROM (UNPIVOT ({CONTRIB}) ON temperature_2m, wind_speed_80m, shortwave_radiation, cloud_cover, soil_moisture INTO NAME feature VALUE value)) WHERE rank <= 3""", d="value")
def top_drivers(spark, sf):
    w = fr.weather(spark, sf).select(
        "region", "ts", (F.col("temperature_2m") - 60).alias("temperature_2m"), (30 - F.col("wind_speed_80m")).alias("wind_speed_80m"), ((F.col("shortwave_radiation") - 500) / 10).alias("shortwave_radiation"),
        (F.col("cloud_cover") - 50.5).alias("cloud_cover"), (F.col("relative_humidity_2m") - 49.3).alias("soil_moisture"))
    feats = ["temperature_2m", "wind_speed_80m", "shortwave_radiation", "cloud_cover", "soil_moisture"]
    return rk.top_drivers(w, ["region", "ts"], feats).drop("line")
