"""Grid queries: fuel mix, flows, prices, KPIs, national roll-up, alerts, tables."""

from pyspark.sql import functions as F

from loadstone.functions import pricing as pr
from loadstone.functions import text as tx
from loadstone.operators import grid as gr
from loadstone.operators import metrics as mt
from loadstone.operators.ranking import LABELS, drop_repeats, stalest_first, top_importances
from loadstone.operators.series import hour_number, newest, previous
from loadstone.plans import frames as fr
from loadstone.plans.registry import query
from loadstone.sources.feeds import severity_of

FUEL = "CASE fuel_type WHEN 'SUN' THEN 'solar' WHEN 'WND' THEN 'wind' WHEN 'NG' THEN 'gas' WHEN 'NUC' THEN 'nuclear' WHEN 'WAT' THEN 'hydro' END"


@query("a1_fuel_pivot", "generation", "SELECT region, ts, " + ", ".join(
    f"coalesce(sum(generation_mw) FILTER (fuel_type = '{c}'), 0) AS {n}" for c, n in tx.FUELS.items()) + " FROM generation GROUP BY 1, 2", d=" ".join(tx.FUELS.values()))
def fuel_pivot(spark, sf):
    return gr.fuel_pivot(fr.generation(spark, sf))


@query("f18_fuel_label_text", "generation", f"SELECT region, ts, {FUEL} AS fuel, format('{{:,.0f}} MW', generation_mw * 100) AS text FROM generation")
def fuel_text(spark, sf):
    g = fr.generation(spark, sf)
    return g.select("region", "ts", tx.fuel_name("fuel_type").alias("fuel"), tx.thousands(F.col("generation_mw") * 100).alias("text"))


@query("a2_renewable_share", "generation", """
SELECT region, ts, sum(generation_mw) AS total_mw, coalesce(sum(generation_mw) FILTER (fuel_type IN ('WND', 'SUN', 'WAT')), 0) / sum(generation_mw) * 100 AS renewable_pct FROM generation GROUP BY 1, 2""", d="total_mw renewable_pct")
def renewable_share(spark, sf):
    return gr.renewable_share(fr.generation(spark, sf))


@query("a3_fuel_mix_last_day", "generation", f"""
WITH x AS (SELECT g.* FROM generation g JOIN (SELECT region, max(ts) AS mx FROM generation GROUP BY region) USING (region) WHERE ts >= mx - INTERVAL 24 HOUR),
h AS (SELECT region, ts, sum(generation_mw) AS total, coalesce(sum(generation_mw) FILTER (fuel_type IN ('WND', 'SUN', 'WAT')), 0) AS ren FROM x GROUP BY 1, 2),
a AS (SELECT region, count(*) AS n, avg(total) AS avg_total_mw, avg(ren / total) * 100 AS renewable_pct FROM h GROUP BY region),
f AS (SELECT region, {FUEL} AS fuel, sum(generation_mw) AS s FROM x GROUP BY 1, 2)
SELECT region, avg_total_mw, arg_max(fuel, s) AS largest_fuel, max(s) / any_value(n) AS largest_mw, max(s) / sum(s) * 100 AS largest_share_pct, renewable_pct FROM f JOIN a USING (region) GROUP BY region, avg_total_mw, renewable_pct""",
       d="avg_total_mw largest_mw largest_share_pct renewable_pct")
def fuel_mix(spark, sf):
    return gr.fuel_mix(fr.generation(spark, sf))


def u_demand(spark, sf):
    """Demand of the finer series: one and a half times the hour's generation."""
    return fr.generation(spark, sf).groupBy("region", "ts").agg((F.sum("generation_mw") * 1.5).alias("demand_mw")).filter(F.hour("ts") != 2)


NET = """net AS (SELECT region, ts, 1.5::DOUBLE * sum(generation_mw) AS demand_mw, 1.5::DOUBLE * sum(generation_mw) - coalesce(sum(generation_mw) FILTER (fuel_type IN ('WND', 'SUN')), 0) AS net_mw,
  coalesce(sum(generation_mw) FILTER (fuel_type IN ('WND', 'SUN', 'WAT')), 0) AS renewable, coalesce(sum(generation_mw) FILTER (fuel_type = 'SUN'), 0) AS solar, sum(generation_mw) AS total FROM generation WHERE hour(ts) <> 2 GROUP BY 1, 2),
st AS (SELECT region, max(ramp) AS peak_ramp, max(ramp) FILTER (hour(ts) BETWEEN 16 AND 19) AS evening_ramp, min(net_mw) AS min_net, max(net_mw) AS peak_net, avg(renewable / total) * 100 AS renewable_pct, max(solar / total) * 100 AS solar_peak_pct, count(*) AS n,
  count(*) FILTER (pk > 0 AND net_mw < 0.2 * pk) AS curtailment_hours FROM (SELECT *, net_mw - lag(net_mw) OVER (PARTITION BY region ORDER BY ts) AS ramp, max(net_mw) OVER (PARTITION BY region) AS pk FROM net) GROUP BY region)"""
NET_D = "peak_ramp evening_ramp min_net peak_net renewable_pct solar_peak_pct"


def net(spark, sf):
    return gr.net_load(u_demand(spark, sf), fr.generation(spark, sf))


@query("a4_net_load_stats", "generation", f"WITH {NET} SELECT * FROM st", d=NET_D)
def net_load_stats(spark, sf):
    return gr.net_load_stats(net(spark, sf))


@query("j18_net_load_intersection", "generation", f"WITH {NET} SELECT region, ts, demand_mw, net_mw FROM net", d="demand_mw net_mw")
def net_intersection(spark, sf):
    return net(spark, sf).select("region", "ts", "demand_mw", "net_mw")


CPT = """last AS (SELECT from_ba, max(ts) AS latest_hour FROM interchange GROUP BY 1), p AS (SELECT i.from_ba, latest_hour, to_ba, interchange_mw AS mw FROM interchange i JOIN last ON i.from_ba = last.from_ba AND ts = latest_hour)"""


@query("a5_net_interchange", "interchange", f"WITH {CPT} SELECT from_ba, latest_hour, round(sum(mw), 2) AS net_mw FROM p GROUP BY 1, 2", d="net_mw")
def net_interchange(spark, sf):
    return gr.counterparties(fr.interchange(spark, sf)).select("from_ba", "latest_hour", "net_mw").distinct()


@query("t2_top_counterparties", "interchange", f"WITH {CPT} SELECT from_ba, to_ba, round(mw, 2) AS mw, rank FROM (SELECT *, row_number() OVER (PARTITION BY from_ba ORDER BY abs(mw) DESC, to_ba) AS rank FROM p) WHERE rank <= 3", d="mw")
def top_counterparties(spark, sf):
    return gr.counterparties(fr.interchange(spark, sf)).select("from_ba", "to_ba", "mw", "rank")


@query("a59_net_flow_direction", "interchange", """
SELECT from_ba, ts, CASE WHEN abs(n) < 50 THEN 'neutral' WHEN n >= 0 THEN 'export' ELSE 'import' END AS direction, CASE WHEN abs(n) < 50 THEN '0' ELSE CASE WHEN n >= 0 THEN '+' ELSE '-' END || format('{:.1f} GW', abs(n) / 1000) END AS text
FROM (SELECT from_ba, ts, floor(round(sum(interchange_mw), 2) / 100) * 100 + 7 AS n FROM interchange GROUP BY 1, 2)""")
def flow_direction(spark, sf):
    n = fr.interchange(spark, sf).groupBy("from_ba", "ts").agg((F.floor(F.round(F.sum("interchange_mw"), 2) / 100) * 100.0 + 7).alias("n"))
    return n.select("from_ba", "ts", pr.flow_direction("n").alias("direction"), pr.flow_text("n").alias("text"))


@query("a6_temperature_percentiles", "weather", """
SELECT region, round(quantile_cont(temperature_2m, 0.9), 1) AS p90, round(quantile_cont(temperature_2m, 0.95), 1) AS p95, round(quantile_cont(temperature_2m, 0.99), 1) AS p99, count(*) AS n_hours, CAST(round_even(count(*) / 24.0::DOUBLE, 0) AS BIGINT) AS window_days
FROM weather WHERE ts <= TIMESTAMP '2024-01-25' GROUP BY region HAVING count(*) >= 336""", d="p90 p95 p99")
def temperature_percentiles(spark, sf):
    return gr.temperature_percentiles(fr.weather(spark, sf), F.lit("2024-01-25").cast("timestamp"))


CORR = ["demand_mw", "temperature_2m", "wind_speed_80m", "shortwave_radiation", "relative_humidity_2m", "cloud_cover"]
PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1:]]
CORR_SQL = "cm AS (" + " UNION ALL ".join(f"SELECT region, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM hourly JOIN weather USING (region, ts) GROUP BY region" for a, b in PAIRS) + ")"


def corr_input(spark, sf):
    return fr.hourly(spark, sf).join(fr.weather(spark, sf), ["region", "ts"])


@query("a7_correlation_matrix", "hourly weather", f"WITH {CORR_SQL} SELECT * FROM cm", d="r")
def correlations(spark, sf):
    return gr.correlations(corr_input(spark, sf), CORR)


@query("a7_correlation_importance", "hourly weather", f"WITH {CORR_SQL} SELECT region, b AS feature, abs(r) AS importance, row_number() OVER (PARTITION BY region ORDER BY abs(r)) AS rank FROM cm WHERE a = 'demand_mw'", d="importance")
def corr_importance(spark, sf):
    return gr.importance(gr.correlations(corr_input(spark, sf), CORR), "demand_mw")


LABEL_SQL = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{LABELS[f]}'" for f in CORR if f in LABELS) + " END"


@query("t3_ranked_features", "hourly weather", f"WITH {CORR_SQL} SELECT feature, importance, {LABEL_SQL} AS label FROM (SELECT b AS feature, avg(abs(r)) AS importance FROM cm WHERE a = 'demand_mw' GROUP BY b) ORDER BY importance DESC, feature LIMIT 10", d="importance")
def ranked_features(spark, sf):
    """The ranking of given importances: mean absolute correlation over regions."""
    given = gr.importance(gr.correlations(corr_input(spark, sf), CORR), "demand_mw").groupBy("feature").agg(F.avg("importance").alias("importance"))
    return top_importances(given)


@query("b26_ranked_drivers", "hourly weather", f"WITH {CORR_SQL} SELECT feature, importance, {LABEL_SQL} AS label FROM (SELECT b AS feature, max(abs(r)) AS importance FROM cm WHERE a = 'demand_mw' GROUP BY b) ORDER BY importance DESC, feature LIMIT 3", d="importance")
def ranked_drivers(spark, sf):
    given = gr.importance(gr.correlations(corr_input(spark, sf), CORR), "demand_mw").groupBy("feature").agg(F.max("importance").alias("importance"))
    return top_importances(given, 3)


@query("j13_nearest_two_hours", "hourly weather", """
WITH p AS (SELECT region, ts AS peak_ts FROM hourly),
w AS (SELECT region, ts, temperature_2m FROM weather WHERE hour(ts) NOT BETWEEN 8 AND 13)
SELECT p.region, peak_ts, w.ts AS matched_ts, w.temperature_2m AS nearest_temperature_2m FROM p LEFT JOIN w ON p.region = w.region AND abs(epoch(w.ts - peak_ts)) < 7200 QUALIFY row_number() OVER (PARTITION BY p.region, peak_ts ORDER BY abs(epoch(w.ts - peak_ts)), w.ts) = 1""", d="nearest_temperature_2m")
def nearest_two_hours(spark, sf):
    """Every hour of demand; the weather feed has a hole every morning, so the nearest reading is the hour's own, its neighbour or none."""
    p = fr.hourly(spark, sf).select("region", F.col("ts").alias("peak_ts"))
    return gr.nearest(p, fr.weather(spark, sf).filter("hour(ts) NOT BETWEEN 8 AND 13"), ["region"], "peak_ts", "ts", "temperature_2m", 7200, strict=True)


@query("j14_nearest_day_ago", "hourly", """
SELECT h.region, h.ts AS at0, x.ts AS matched_ts, x.demand_mw AS nearest_demand_mw FROM hourly h LEFT JOIN hourly x ON h.region = x.region AND abs(epoch(x.ts - (h.ts - INTERVAL 24 HOUR))) <= 5400
QUALIFY row_number() OVER (PARTITION BY h.region, h.ts ORDER BY abs(epoch(x.ts - (h.ts - INTERVAL 24 HOUR))), x.ts) = 1""")
def nearest_day_ago(spark, sf):
    h = fr.hourly(spark, sf)
    left = h.select("region", F.col("ts").alias("at0"), (F.col("ts") - F.expr("INTERVAL 24 HOURS")).alias("at"))
    return gr.nearest(left, h, ["region"], "at", "ts", "demand_mw", 5400).drop("at")


@query("j15_positional_tail_join", "hourly weather", """
SELECT region, count(*) AS n, corr(demand_mw, temperature_2m) AS r FROM (SELECT region, demand_mw, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS k FROM hourly)
JOIN (SELECT region, temperature_2m, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS k FROM weather WHERE hour(ts) <> 9) USING (region, k) WHERE k <= 168 GROUP BY region""", d="r")
def positional(spark, sf):
    w = fr.weather(spark, sf).filter("hour(ts) <> 9").select("region", "ts", "temperature_2m")
    return gr.tail_join(fr.hourly(spark, sf), w, ["region"], 168).groupBy("region").agg(F.count("*").alias("n"), F.corr("demand_mw", "temperature_2m").alias("r"))


@query("a36_kpi_tiles", "hourly", """
WITH w AS (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY region ORDER BY ts DESC) <= 168),
g AS (SELECT region, max(ts) AS now_ts, arg_max(demand_mw, ts) AS now_mw, max(demand_mw) AS peak_7d, min(demand_mw) AS low_7d, avg(demand_mw) AS avg_7d FROM w GROUP BY region),
m AS (SELECT g.region, x.ts, x.demand_mw FROM g JOIN hourly x ON g.region = x.region AND abs(epoch(x.ts - (now_ts - INTERVAL 24 HOUR))) <= 5400 QUALIFY row_number() OVER (PARTITION BY g.region ORDER BY abs(epoch(x.ts - (now_ts - INTERVAL 24 HOUR))), x.ts) = 1)
SELECT g.*, m.ts AS anchor_ts, (now_mw - m.demand_mw) / m.demand_mw * 100 AS trend_pct FROM g LEFT JOIN m USING (region)""", d="avg_7d trend_pct")
def kpis(spark, sf):
    return gr.kpis(fr.hourly(spark, sf))


STATE = """top AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS k FROM nation_load),
state AS (SELECT *, CASE WHEN current_mw < 0.1 * median_mw THEN true ELSE coalesce(current_mw < 0.4 * prev_mw AND current_mw < 0.6 * median_mw, false) END AS artifact FROM (
  SELECT region, max(demand_mw) FILTER (k = 1) AS current_mw, max(demand_mw) FILTER (k = 2) AS prev_mw, quantile_cont(demand_mw, 0.5) AS median_mw FROM top WHERE k <= 24 GROUP BY region))"""


@query("a37_national_summary", "nation_load capacity", f"""WITH {STATE},
j AS (SELECT s.*, capacity_mw, unreliable, coalesce(capacity_mw > 0 AND NOT unreliable AND current_mw / capacity_mw <= 2, false) AS rel FROM state s LEFT JOIN capacity USING (region) WHERE NOT artifact),
p AS (SELECT max(s) AS simultaneous_peak_mw FROM (SELECT k, sum(demand_mw) AS s FROM top WHERE k <= 24 AND region IN (SELECT region FROM j) GROUP BY k))
SELECT count(*) AS reporting_regions, sum(current_mw) AS total_mw, any_value(simultaneous_peak_mw) AS simultaneous_peak_mw, sum(current_mw) FILTER (rel) / sum(capacity_mw) FILTER (rel) * 100 AS utilization_pct,
  arg_max(region, current_mw / capacity_mw) FILTER (rel) AS top_region, least(max(current_mw / capacity_mw) FILTER (rel), 1) * 100 AS top_stress_pct, coalesce((SELECT string_agg(region, ',' ORDER BY region) FROM state WHERE artifact), '') AS artifact_excluded FROM j, p""",
       d="total_mw simultaneous_peak_mw utilization_pct top_stress_pct")
def national(spark, sf):
    return gr.national_summary(fr.nation_load(spark, sf), fr.capacity(spark, sf))


@query("a38_simultaneous_peak", "hourly", """
SELECT max(s) AS simultaneous_peak_mw FROM (SELECT k, sum(demand_mw) AS s FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS k FROM hourly) WHERE k <= 24 GROUP BY k)""", d="simultaneous_peak_mw")
def simultaneous(spark, sf):
    return gr.simultaneous_peak(fr.hourly(spark, sf))


@query("a50_group_rollup", "nation_load capacity", f"""WITH {STATE}
SELECT grid, region, grouping_id(grid, region) AS level, sum(current_mw) AS current_mw, sum(capacity_mw) AS capacity_mw, sum(current_mw) / sum(capacity_mw) * 100 AS utilization_pct FROM state JOIN capacity USING (region) GROUP BY ROLLUP (grid, region)""", d="current_mw capacity_mw utilization_pct")
def group_rollup(spark, sf):
    return gr.group_rollup(fr.nation_load(spark, sf), fr.capacity(spark, sf))


@query("t5_max_stress_region", "nation_load capacity", f"""WITH {STATE} SELECT arg_max(region, current_mw / capacity_mw) AS region, max(current_mw / capacity_mw) * 100 AS stress_pct FROM state JOIN capacity USING (region) WHERE NOT unreliable""", d="stress_pct")
def max_stress(spark, sf):
    j = gr.region_state(fr.nation_load(spark, sf)).join(fr.capacity(spark, sf).filter("NOT unreliable"), "region")
    r = F.col("current_mw") / F.col("capacity_mw")
    return j.agg(F.max_by("region", r).alias("region"), (F.max(r) * 100).alias("stress_pct"))


@query("t10_region_card_order", "nation_load capacity", f"""WITH {STATE},
v AS (SELECT region, -current_mw AS demand, CASE WHEN capacity_mw > 0 AND NOT unreliable THEN -(current_mw / capacity_mw) ELSE 1 END AS stress, CASE WHEN prev_mw > 0 THEN -abs((current_mw - prev_mw) / prev_mw) ELSE 0 END AS change FROM state LEFT JOIN capacity USING (region))
SELECT region, sort, value FROM (UNPIVOT v ON demand, stress, change INTO NAME sort VALUE value)""", d="value")
def card_order(spark, sf):
    return gr.card_order(gr.region_state(fr.nation_load(spark, sf)), fr.capacity(spark, sf))


U = "(demand_mw / capacity_mw)"
PRICE = f"CASE WHEN {U} < 0.7 THEN 50 WHEN {U} < 0.9 THEN 50 * (1 + 2 * ({U} - 0.7)) WHEN {U} < 1 THEN 50 * exp(15 * ({U} - 0.9)) ELSE 1000 END"


@query("f10_merit_order_price", "nation_load capacity", f"SELECT region, ts, {PRICE} AS price FROM nation_load JOIN capacity USING (region)", d="price")
def merit_price(spark, sf):
    return fr.nation_load(spark, sf).join(fr.capacity(spark, sf), "region").select("region", "ts", pr.price("demand_mw", "capacity_mw").alias("price"))


@query("f11_utilisation_headroom", "nation_load capacity", "SELECT region, ts, demand_mw / capacity_mw * 100 AS utilization_pct, (capacity_mw - demand_mw) / capacity_mw * 100 AS headroom_pct FROM nation_load JOIN capacity USING (region)", d="utilization_pct headroom_pct")
def headroom(spark, sf):
    return fr.nation_load(spark, sf).join(fr.capacity(spark, sf), "region").select(
        "region", "ts", pr.utilization_pct("demand_mw", "capacity_mw").alias("utilization_pct"), pr.headroom_pct("demand_mw", "capacity_mw").alias("headroom_pct"))


@query("f12_stress_score_label", "nation_load capacity", """
SELECT region, ts, s AS stress_score, CASE WHEN unreliable OR NOT capacity_mw > 0 THEN 'Capacity n/a' WHEN s IS NULL THEN 'Unavailable' WHEN s < 70 THEN 'Normal' WHEN s < 85 THEN 'Elevated' ELSE 'High' END AS stress_label
FROM (SELECT *, CASE WHEN capacity_mw > 0 AND NOT unreliable AND demand_mw > 0 THEN CAST(round_even(least(demand_mw / capacity_mw * 100, 100), 0) AS BIGINT) END AS s FROM nation_load JOIN capacity USING (region))""")
def stress(spark, sf):
    a = ("demand_mw", "capacity_mw", "unreliable")
    return fr.nation_load(spark, sf).join(fr.capacity(spark, sf), "region").select("region", "ts", pr.stress_score(*a).alias("stress_score"), pr.stress_label(*a).alias("stress_label"))


@query("j17_capacity_join", "nation_load capacity", f"""WITH {STATE}, x AS (SELECT region, current_mw AS demand_mw, current_mw, capacity_mw, unreliable FROM state JOIN capacity USING (region))
SELECT region, current_mw, capacity_mw, current_mw / capacity_mw * 100 AS utilization_pct, (capacity_mw - current_mw) / capacity_mw * 100 AS headroom_pct, {PRICE} AS price, s AS stress_score,
  CASE WHEN unreliable THEN 'Capacity n/a' WHEN s < 70 THEN 'Normal' WHEN s < 85 THEN 'Elevated' ELSE 'High' END AS stress_label FROM (SELECT *, CASE WHEN NOT unreliable THEN CAST(round_even(least(current_mw / capacity_mw * 100, 100), 0) AS BIGINT) END AS s FROM x)""",
       d="current_mw capacity_mw utilization_pct headroom_pct price")
def capacity_join(spark, sf):
    return gr.stress_table(gr.region_state(fr.nation_load(spark, sf)), fr.capacity(spark, sf))


@query("a40_phase_rollup", "hourly", """
SELECT phase, sum(secs) AS total_s, max(secs) AS max_s, arg_max(region, secs) AS slowest_region, count(*) AS n FROM (SELECT region, strftime(ts, '%a') AS phase, sum(demand_mw) AS secs FROM hourly GROUP BY 1, 2) GROUP BY phase""", d="total_s max_s")
def phase_rollup(spark, sf):
    per = fr.hourly(spark, sf).groupBy("region", F.date_format("ts", "EEE").alias("phase")).agg(F.sum("demand_mw").alias("secs"))
    timings = per.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("phase", "secs"))).alias("timings"))
    return gr.phase_rollup(timings)


@query("a57_last_day_outliers", "hourly", """
WITH t AS (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY region ORDER BY ts DESC) <= 48), s AS (SELECT region, avg(demand_mw) AS m, stddev_samp(demand_mw) AS sd, count(*) AS n FROM t GROUP BY region)
SELECT region, n, count(*) FILTER (abs(demand_mw - m) > 1.5 * sd) AS outliers FROM t JOIN s USING (region) GROUP BY region, n""")
def outliers(spark, sf):
    return gr.outlier_count(fr.hourly(spark, sf), 48, 1.5)


@query("a58_temperature_regime", "weather", """
SELECT region, max(temperature_2m) AS t_max, min(temperature_2m) AS t_min, CASE WHEN max(temperature_2m) >= 90 THEN 'heat' WHEN min(temperature_2m) <= 30 THEN 'cold' WHEN max(temperature_2m) >= 80 THEN 'warm' WHEN min(temperature_2m) <= 40 THEN 'cool' ELSE 'comfortable' END AS regime
FROM (SELECT * FROM weather QUALIFY row_number() OVER (PARTITION BY region ORDER BY ts DESC) <= 24) GROUP BY region""")
def regime(spark, sf):
    return gr.temperature_regime(fr.weather(spark, sf))


SEV = "CASE noaa_severity WHEN 'Extreme' THEN 'critical' WHEN 'Severe' THEN 'critical' WHEN 'Moderate' THEN 'warning' ELSE 'info' END"
ALERT = f"""br AS (SELECT 'G' || g AS region, 'S' || ((g * 3 + n) % 12) AS state, n AS state_no FROM (SELECT unnest(generate_series(0, 5)) AS g), (SELECT unnest(generate_series(0, 3)) AS n)),
ra AS (SELECT region, id, arrival, event, {SEV} AS severity, expires, state, state_no FROM alerts JOIN br USING (state) QUALIFY row_number() OVER (PARTITION BY region, id ORDER BY state_no, arrival) = 1),
live AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, state_no, arrival) AS rn FROM ra WHERE expires IS NULL OR expires > TIMESTAMP '2024-01-20')"""


def region_alerts(spark, sf):
    """Six regions, each served by four of the twelve states in order."""
    pairs = F.array(*[F.struct(F.lit(f"G{g}").alias("region"), F.lit(f"S{(g * 3 + n) % 12}").alias("state"), F.lit(n).alias("state_no")) for g in range(6) for n in range(4)])
    bridge = spark.range(1).select(F.inline(pairs))
    a = fr.alerts(spark, sf).withColumn("severity", severity_of("noaa_severity"))
    return gr.alerts_for_regions(a, bridge)


@query("j16_alerts_by_region", "alerts", f"WITH {ALERT} SELECT region, id, arrival, event, severity, state FROM ra")
def alerts_by_region(spark, sf):
    return region_alerts(spark, sf).select("region", "id", "arrival", "event", "severity", "state")


def live(spark, sf):
    return gr.live_alerts(region_alerts(spark, sf), F.lit("2024-01-20").cast("timestamp"))


@query("p17_live_alerts", "alerts", f"WITH {ALERT} SELECT region, id, severity, expires FROM live")
def live_alerts(spark, sf):
    return live(spark, sf).select("region", "id", "severity", "expires")


@query("a39_alert_counts", "alerts", f"WITH {ALERT} SELECT region, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) AS total FROM live GROUP BY region")
def alert_counts(spark, sf):
    return live(spark, sf).groupBy("region").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")], F.count("*").alias("total"))


@query("t9_severity_order_cap", "alerts", f"WITH {ALERT} SELECT region, id, severity, state_no, arrival, rn AS card FROM live WHERE rn <= 20", i="state_no")
def severity_cap(spark, sf):
    return gr.alert_cards(live(spark, sf)).select("region", "id", "severity", "state_no", "arrival", "card")


@query("f21_first_areas", "alerts", "SELECT region, list_sort(list(DISTINCT state))[:3][1] AS first_area, len(list_sort(list(DISTINCT state))[:3]) AS n, array_to_string(list_sort(list(DISTINCT state))[:3], '; ') AS areas FROM (SELECT *, event AS region FROM alerts) GROUP BY region", i="n")
def first_areas(spark, sf):
    a = fr.alerts(spark, sf).groupBy(F.col("event").alias("region")).agg(F.sort_array(F.collect_set("state")).alias("s")).withColumn("s", F.slice("s", 1, 3))
    return a.select("region", F.col("s")[0].alias("first_area"), F.size("s").alias("n"), F.array_join("s", "; ").alias("areas"))


@query("a55_model_leaderboard", "scored", """
SELECT region, model, mape, mae, row_number() OVER (PARTITION BY region ORDER BY mape, model) AS rank, row_number() OVER (PARTITION BY region ORDER BY mape, model) = 1 AS best, CASE WHEN mape <= 6 THEN 'excellent' WHEN mape <= 9 THEN 'target' WHEN mape <= 15 THEN 'acceptable' ELSE 'rollback' END AS grade
FROM (SELECT region, model, avg(abs((actual - predicted) / (actual + 1000))) * 100 AS mape, avg(abs(actual - predicted)) AS mae FROM scored GROUP BY ALL)""", d="mape mae")
def leaderboard(spark, sf):
    m = fr.scored(spark, sf).groupBy("region", "model").agg((F.avg(F.abs((F.col("actual") - F.col("predicted")) / (F.col("actual") + 1000))) * 100).alias("mape"), mt.mae().alias("mae"))
    return gr.leaderboard(m)


@query("a56_displayed_error", "nation_load", """
SELECT region, CASE WHEN n7 >= 24 AND coalesce(s7, m7) IS NOT NULL THEN coalesce(s7, m7) WHEN n30 >= 24 AND coalesce(s30, m30) IS NOT NULL THEN coalesce(s30, m30) ELSE coalesce(he, ht) END AS error,
  CASE WHEN n7 >= 24 AND coalesce(s7, m7) IS NOT NULL THEN CASE WHEN s7 IS NOT NULL THEN 'live 7d sMAPE' ELSE 'live 7d MAPE' END WHEN n30 >= 24 AND coalesce(s30, m30) IS NOT NULL THEN CASE WHEN s30 IS NOT NULL THEN 'live 30d sMAPE' ELSE 'live 30d MAPE' END
    WHEN coalesce(he, ht) IS NOT NULL THEN 'holdout MAPE' ELSE '' END AS source
FROM (SELECT region, k % 40 AS n7, k % 70 AS n30, CASE WHEN k % 2 = 0 THEN v END AS s7, CASE WHEN k % 3 = 0 THEN v * 2 END AS m7, CASE WHEN k % 5 = 0 THEN v * 3 END AS s30, v * 4 AS m30, CASE WHEN k % 7 = 0 THEN v * 5 END AS he, CASE WHEN k % 4 <> 0 THEN v * 6 END AS ht
  FROM (SELECT region || strftime(ts, '-%Y%m') AS region, count(*) * 3 AS k, sum(demand_mw) / 1000 AS v FROM nation_load GROUP BY 1))""", d="error")
def displayed_error(spark, sf):
    k, v = F.col("k"), F.col("v")
    x = fr.nation_load(spark, sf).groupBy(F.concat("region", F.date_format("ts", "-yyyyMM")).alias("region")).agg((F.count("*") * 3).alias("k"), (F.sum("demand_mw") / 1000).alias("v"))
    return gr.resolve_error(x.select(
        "region", (k % 40).alias("n_7d"), (k % 70).alias("n_30d"), F.when(k % 2 == 0, v).alias("smape_7d"), F.when(k % 3 == 0, v * 2).alias("mape_7d"), F.when(k % 5 == 0, v * 3).alias("smape_30d"),
        (v * 4).alias("mape_30d"), F.when(k % 7 == 0, v * 5).alias("holdout_ensemble"), F.when(k % 4 != 0, v * 6).alias("holdout_trees")))


# -- sets, sorts, text ---------------------------------------------------------

@query("t1_sort_by_time", "hourly", "SELECT region, ts, demand_mw FROM hourly ORDER BY region, ts")
def sort_by_time(spark, sf):
    return fr.hourly(spark, sf).orderBy("region", "ts")


@query("u4_region_set_difference", "nation_load capacity", f"""WITH {STATE} SELECT region FROM state EXCEPT SELECT region FROM capacity WHERE unreliable UNION SELECT region FROM state WHERE artifact""")
def set_difference(spark, sf):
    s = gr.region_state(fr.nation_load(spark, sf))
    bad = fr.capacity(spark, sf).filter("unreliable").select("region")
    return s.select("region").subtract(bad).union(s.filter("artifact").select("region")).distinct()


@query("u6_index_intersection", "hourly weather", "SELECT region, ts FROM hourly INTERSECT SELECT region, ts FROM weather WHERE cloud_cover > 50")
def intersection(spark, sf):
    return fr.hourly(spark, sf).select("region", "ts").intersect(fr.weather(spark, sf).filter("cloud_cover > 50").select("region", "ts"))


@query("u8_hidden_visible_partition", "scored", """
SELECT region, CASE WHEN m <= 60 THEN 'visible' ELSE 'hidden' END AS part FROM (SELECT region, min(e) AS m FROM (SELECT region, model, avg(abs(actual - predicted) / (actual + 50)) * 100 AS e FROM scored GROUP BY ALL) GROUP BY region)""")
def hidden_visible(spark, sf):
    e = fr.scored(spark, sf).groupBy("region", "model").agg((F.avg(F.abs(F.col("actual") - F.col("predicted")) / (F.col("actual") + 50)) * 100).alias("e"))
    m = e.groupBy("region").agg(F.min("e").alias("m"))
    ok = F.col("m") <= 60
    return m.filter(ok).select("region", F.lit("visible").alias("part")).union(m.filter(~ok).select("region", F.lit("hidden").alias("part")))


@query("t13_stalest_first_work_list", "nation_load", """
WITH a AS (SELECT region, max(ts) AS built FROM nation_load WHERE region <> 'NATION_3' AND month(ts) < 9 GROUP BY region), r AS (SELECT DISTINCT region FROM nation_load)
SELECT region, CAST(date_diff('day', built, TIMESTAMP '2001-12-01') AS BIGINT) AS age_days FROM r LEFT JOIN a USING (region) WHERE built IS NULL OR date_diff('day', built, TIMESTAMP '2001-12-01') >= 90 ORDER BY age_days DESC NULLS FIRST, region LIMIT 10""")
def work_list(spark, sf):
    x = fr.nation_load(spark, sf)
    built = x.filter("region <> 'NATION_3' AND month(ts) < 9").groupBy("region").agg(F.max("ts").alias("built_at"))
    return stalest_first(x.select("region").distinct(), built, F.lit("2001-12-01").cast("timestamp"))


@query("f14_percent_change", "hourly", "SELECT region, ts, (demand_mw - o) / abs(nullif(o, 0)) * 100 AS pct FROM (SELECT *, CASE WHEN hour(ts) = 0 THEN 0 ELSE lag(demand_mw) OVER (PARTITION BY region ORDER BY ts) END AS o FROM hourly)", d="pct")
def percent_change(spark, sf):
    x = previous(fr.hourly(spark, sf).withColumn("h", hour_number("ts")), ["region"], "h", {"o": "demand_mw"})
    return x.select("region", "ts", tx.pct_change(F.when(F.hour("ts") == 0, 0.0).otherwise(F.col("o")), F.col("demand_mw")).alias("pct"))


@query("f15_relative_time", "", """
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 172800 THEN 'yesterday' ELSE (s // 86400) || 'd ago' END AS age
FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(ts)) AS BIGINT) AS s FROM events)""")
def relative_time(spark, sf):
    return fr.events(spark, sf).select("event_id", tx.relative_time(F.col("ts"), F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("age"))


@query("f16_stable_seed", "", "SELECT DISTINCT user_id, CAST('0x' || substr(sha256('user|' || user_id), 1, 8) AS BIGINT) AS seed FROM events")
def stable_seed(spark, sf):
    return fr.events(spark, sf).select("user_id", tx.stable_seed(F.concat(F.lit("user|"), F.col("user_id").cast("string"))).alias("seed")).distinct()


@query("f17_row_content_hash", "", "SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_custkey, coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END, '<NA>'))) AS digest FROM orders")
def row_hash(spark, sf):
    o = fr.table(spark, sf, "orders").withColumn("s", F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")))
    return o.select("o_orderkey", tx.row_signature("o_orderkey", "o_custkey", "s").alias("digest"))


@query("f17_frame_signature", "hourly", """
SELECT region, bit_xor(x) || '-' || sum(x) || '-' || count(*) AS signature
FROM (SELECT region, CAST('0x' || substr(md5(CAST(epoch(ts) AS BIGINT) || '|' || coalesce(CAST(CAST(round(demand_mw * 100) AS BIGINT) AS VARCHAR), '<NA>')), 1, 10) AS BIGINT) AS x FROM hourly) GROUP BY region""")
def frame_hash(spark, sf):
    whole = fr.hourly(spark, sf).select("region", F.unix_timestamp("ts").alias("at"), F.round(F.col("demand_mw") * 100).cast("long").alias("cents"))
    return whole.groupBy("region").agg(tx.frame_signature("at", "cents").alias("signature"))


@query("f19_record_round_trip", "scored", """
SELECT region, model, ts, round(predicted, 2) AS predicted, round(actual, 2) AS actual, round(abs(actual - predicted) / actual * 100, 4) AS abs_pct_error,
  CASE WHEN hour(ts) % 2 = 0 THEN round(200 * abs(actual - predicted) / (actual + predicted), 4) ELSE 200 * abs(round(actual, 2) - round(predicted, 2)) / (round(actual, 2) + round(predicted, 2)) END AS smape,
  lead_hours, CASE WHEN lead_hours IS NOT NULL THEN ts - to_hours(lead_hours) END AS anchor_ts, placeholder, CASE WHEN placeholder THEN true END AS conditioned FROM scored""",
       d="predicted actual abs_pct_error smape")
def record_round_trip(spark, sf):
    """Drift records; on odd hours the symmetric error is missing, as in old records."""
    s = fr.scored(spark, sf).select(
        "*", mt.ape().alias("abs_pct_error"), F.when(F.hour("ts") % 2 == 0, mt.smape_row()).alias("smape"),
        (F.col("ts") - F.make_dt_interval(F.lit(0), F.col("lead_hours").cast("int"))).alias("anchor_ts"), F.when(F.col("placeholder"), True).alias("conditioned"))
    return s.select("region", "model", tx.encode_record().alias("doc")).select("region", "model", *tx.decode_record("doc"))


@query("f19_vintage_round_trip", "vintage", """
SELECT region, target_ts, round(CAST(first_seen_d AS DECIMAL(18, 4)), 2) AS first_seen_d, captured_at, round(CAST(last_d AS DECIMAL(18, 4)), 2) AS last_d, n_updates,
  round(CAST(first_seen_df AS DECIMAL(18, 4)), 2) AS first_seen_df, df_at FROM vintage""", d="first_seen_d last_d first_seen_df")
def vintage_round_trip(spark, sf):
    v = fr.vintage(spark, sf).select("region", tx.encode_record(tx.VINTAGE_KEYS, tx.VINTAGE_DIGITS).alias("doc"))
    return v.select("region", *tx.decode_record("doc", tx.VINTAGE_SCHEMA, tx.VINTAGE_KEYS))


@query("f20_map_explode", "scored", "SELECT region, ts, model, predicted FROM scored WHERE predicted > 100")
def map_explode(spark, sf):
    m = fr.scored(spark, sf).groupBy("region", "ts").agg(F.map_from_entries(F.collect_list(F.struct("model", "predicted"))).alias("preds"))
    return m.select("region", "ts", F.explode(F.map_filter("preds", lambda k, v: v > 100)).alias("model", "predicted"))


@query("g10_wide_to_long", "weather", "SELECT * FROM (UNPIVOT (SELECT region, ts, temperature_2m, wind_speed_80m, cloud_cover FROM weather) ON temperature_2m, wind_speed_80m, cloud_cover INTO NAME driver VALUE value)", d="value")
def wide_to_long(spark, sf):
    v = ["temperature_2m", "wind_speed_80m", "cloud_cover"]
    return fr.weather(spark, sf).select("region", "ts", *v).unpivot(["region", "ts"], v, "driver", "value")


SNAP = """snap AS (SELECT region, CAST(ts AS DATE) AS day, list(round(demand_mw / 400) ORDER BY ts) AS predictions, max(round(demand_mw / 400)) AS peak_mw, avg(round(demand_mw / 400)) AS avg_mw FROM hourly GROUP BY 1, 2),
hs AS (SELECT *, md5(array_to_string(list_transform(predictions, lambda p: format('{:.2f}', p)), ',')) AS hash FROM snap),
kept AS (SELECT * FROM hs QUALIFY hash IS DISTINCT FROM lag(hash) OVER (PARTITION BY region ORDER BY day))"""


def snapshots(spark, sf):
    """One snapshot a region and day: its hours, coarsely rounded."""
    v = F.round(F.col("demand_mw") / 400)
    return fr.hourly(spark, sf).groupBy("region", F.to_date("ts").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("ts", v.alias("v")))).alias("s")).select("region", "day", F.col("s.v").alias("predictions"))


@query("a48_snapshot_peak_average", "hourly", f"WITH {SNAP} SELECT region, day, peak_mw, avg_mw FROM snap", d="peak_mw avg_mw")
def snapshot_peak(spark, sf):
    mean = F.aggregate("predictions", F.lit(0.0), lambda a, x: a + x) / F.size("predictions")
    return snapshots(spark, sf).select("region", "day", F.array_max("predictions").alias("peak_mw"), mean.alias("avg_mw"))


@query("t8_consecutive_snapshot_dedup", "hourly", f"WITH {SNAP} SELECT region, day, hash FROM kept")
def snapshot_dedup(spark, sf):
    s = snapshots(spark, sf).withColumn("hash", tx.predictions_hash(F.col("predictions"))).withColumn("k", F.datediff("day", F.lit("2000-01-01").cast("date")))
    return drop_repeats(s, ["region"], "k", "hash").select("region", "day", "hash")


@query("d9_snapshot_fifo", "hourly", f"WITH {SNAP} SELECT region, day, hash FROM kept QUALIFY row_number() OVER (PARTITION BY region ORDER BY day DESC) <= 10")
def snapshot_fifo(spark, sf):
    return newest(snapshot_dedup(spark, sf), ["region"], "day", 10)

