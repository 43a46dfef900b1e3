"""Forecast queries: metrics, baselines, ensembles, checks, folds, intervals."""

from pyspark.sql import functions as F

from loadstone.functions import calendar as cal
from loadstone.operators import backtest as bt
from loadstone.operators import baseline as bl
from loadstone.operators import ensemble as en
from loadstone.operators import metrics as mt
from loadstone.operators.insights import ensemble_weight_insight
from loadstone.operators.quantiles import percentiles
from loadstone.operators.series import hour_number, hours, newest, windowed, with_position
from loadstone.plans import frames as fr
from loadstone.plans.q_sources import METADATA_SQL, metadata
from loadstone.plans.registry import query
from loadstone.session import stored


@query("a14_mape", "scored", "SELECT region, model, avg(CASE WHEN abs(actual) > 1e-6 THEN abs((actual - predicted) / actual) END) * 100 AS mape, avg(CASE WHEN actual > 50 THEN abs(actual - predicted) / actual END) * 100 AS mape_above_50 FROM scored GROUP BY ALL",
       d="mape mape_above_50")
def mape(spark, sf):
    high = F.when(F.col("actual") > 50, F.col("actual"))
    return fr.scored(spark, sf).groupBy("region", "model").agg(mt.mape().alias("mape"), mt.positive_mape(high).alias("mape_above_50"))


@query("a15_rmse_mae_r2", "scored", """
SELECT region, model, sqrt(avg(pow(actual - predicted, 2))) AS rmse, avg(abs(actual - predicted)) AS mae, 1 - sum(pow(actual - predicted, 2)) / sum(pow(actual - m, 2)) AS r2
FROM (SELECT *, avg(actual) OVER (PARTITION BY region, model) AS m FROM scored) GROUP BY ALL""", d="rmse mae r2")
def rmse_mae_r2(spark, sf):
    return fr.scored(spark, sf).groupBy("region", "model").agg(mt.rmse().alias("rmse"), mt.mae().alias("mae"), mt.r2().alias("r2"))


@query("a16_wape", "scored", "SELECT region, model, sum(abs(actual - predicted)) / sum(abs(actual)) * 100 AS wape FROM scored GROUP BY ALL", d="wape")
def wape(spark, sf):
    return fr.scored(spark, sf).groupBy("region", "model").agg(mt.wape().alias("wape"))


@query("a17_signed_bias", "scored", "SELECT region, model, avg((predicted - actual) / actual) * 100 AS bias_pct FROM scored GROUP BY ALL", d="bias_pct")
def bias(spark, sf):
    return fr.scored(spark, sf).groupBy("region", "model").agg(mt.bias_pct().alias("bias_pct"))


@query("a18_smape", "scored", "SELECT region, model, avg(200 * abs(actual - predicted) / (abs(actual) + abs(predicted))) AS smape FROM scored GROUP BY ALL", d="smape")
def smape(spark, sf):
    return fr.scored(spark, sf).groupBy("region", "model").agg(mt.smape().alias("smape"))


@query("a13_error_by_hour", "scored", """
SELECT region, model, hour(ts) AS hour, avg(abs(actual - predicted)) AS mean_abs_error, stddev_samp(abs(actual - predicted)) AS std_abs_error, count(*) AS count FROM scored GROUP BY 1, 2, 3""",
       d="mean_abs_error std_abs_error")
def error_by_hour(spark, sf):
    return mt.error_by_hour(fr.scored(spark, sf), ["region", "model"])


@query("f9_percentage_error_residual", "scored", "SELECT region, model, ts, abs(actual - predicted) / abs(actual) * 100 AS ape, actual - predicted AS residual FROM scored", d="ape residual")
def residuals(spark, sf):
    return fr.scored(spark, sf).select("region", "model", "ts", mt.ape().alias("ape"), mt.residual().alias("residual"))


def scores(spark, sf):
    return fr.scored(spark, sf).groupBy("region", "model").agg(mt.mape().alias("mape"))


SCORES = "scores AS (SELECT region, model, avg(abs((actual - predicted) / actual)) * 100 AS mape FROM scored GROUP BY ALL)"


@query("a22_headline_distribution", "scored", f"""WITH {SCORES},
h AS (SELECT region, coalesce(max(mape) FILTER (model = 'lag168' AND region <> 'click'), max(mape) FILTER (model = 'lag24' AND region <> 'view'), min(mape)) AS headline FROM scores GROUP BY region)
SELECT min(headline) AS min, quantile_cont(headline, 0.5) AS median, avg(headline) AS mean, quantile_cont(headline, 0.9) AS p90, max(headline) AS max, count(*) AS n FROM h""", d="min median mean p90 max")
def headline_distribution(spark, sf):
    """Headline per region (ensemble, else trees, else best), then its distribution."""
    s = scores(spark, sf)
    def of(model, gap):
        return F.max(F.when((F.col("model") == model) & (F.col("region") != gap), F.col("mape")))
    h = s.groupBy("region").agg(F.coalesce(of("lag168", "click"), of("lag24", "view"), F.min("mape")).alias("headline"))
    return h.agg(F.min("headline").alias("min"), F.percentile("headline", F.lit(0.5)).alias("median"), F.avg("headline").alias("mean"),
                 F.percentile("headline", F.lit(0.9)).alias("p90"), F.max("headline").alias("max"), F.count("*").alias("n"))


@query("a23_error_quantiles", "scored", """
SELECT region, model, count(*) AS sample_size, quantile_cont(actual - predicted, 0.1) AS lower_error, quantile_cont(actual - predicted, 0.9) AS upper_error FROM scored GROUP BY ALL""", d="lower_error upper_error")
def error_quantiles(spark, sf):
    return mt.error_quantiles(fr.scored(spark, sf), ["region", "model"])


BAND = """q AS (SELECT region, model, quantile_cont(actual - predicted, 0.1) AS lo, quantile_cont(actual - predicted, 0.9) AS up FROM scored GROUP BY ALL),
band AS (SELECT s.*, predicted + lo AS lower, predicted + up AS upper FROM scored s JOIN q USING (region, model))"""


def band(spark, sf):
    s = stored(fr.scored(spark, sf), "scored")
    return mt.apply_interval(s, mt.error_quantiles(s, ["region", "model"]), ["region", "model"])


@query("b10_interval_application", "scored", f"WITH {BAND} SELECT region, model, ts, lower, upper FROM band", d="lower upper")
def interval(spark, sf):
    return band(spark, sf).select("region", "model", "ts", "lower", "upper")


@query("a24_interval_coverage", "scored", f"""WITH {BAND}
SELECT region, model, avg((actual >= lower AND actual <= upper)::INT) AS overall_coverage, avg((actual >= lower AND actual <= upper)::INT) FILTER (rn <= 168) AS recent_coverage, recent_coverage - 0.8 AS drift
FROM (SELECT *, row_number() OVER (PARTITION BY region, model ORDER BY ts DESC) AS rn FROM band) GROUP BY ALL""", d="overall_coverage recent_coverage drift")
def coverage(spark, sf):
    return mt.interval_coverage(band(spark, sf), ["region", "model"])


# -- baselines --------------------------------------------------------------

NAIVE = """ends AS (SELECT region, max(h) AS last, max(h) - min(h) + 1 AS n FROM spine GROUP BY region),
known AS (SELECT region, h % 24 AS phase, arg_max(demand_mw, h) AS predicted FROM spine WHERE demand_mw IS NOT NULL GROUP BY 1, 2),
naive AS (SELECT e.region, to_timestamp((last + k) * 3600)::TIMESTAMP AS ts, k AS lead_hours, predicted FROM ends e, LATERAL (SELECT unnest(generate_series(1, 720)) AS k) JOIN known ON known.region = e.region AND known.phase = (last + k) % 24
  WHERE n >= 24 AND e.region IN (SELECT region FROM known GROUP BY region HAVING count(*) = 24))"""


def naive(spark, sf):
    return bl.seasonal_naive(fr.demand(spark, sf), 720)


@query("b2_seasonal_naive_forecast", "spine", f"WITH {NAIVE} SELECT * FROM naive")
def seasonal_naive(spark, sf):
    return naive(spark, sf)


@query("b4_baseline_substitution", "spine", """
SELECT region, n_hours, baseline_mape, model_mape, baseline_mape - model_mape AS points, CASE WHEN n_hours < 168 THEN 'too_few_hours' WHEN baseline_mape - model_mape > -2 THEN 'within_points' ELSE 'serve' END AS decision
FROM (SELECT region, count(demand_mw) AS n_hours, avg(abs(demand_mw - l) / demand_mw) * 100 AS baseline_mape, avg(abs(demand_mw - l2) / demand_mw) * 100 AS model_mape
  FROM (SELECT *, lag(demand_mw, 24) OVER w AS l, lag(demand_mw, 48) OVER w AS l2 FROM spine WINDOW w AS (PARTITION BY region ORDER BY h)) GROUP BY region)""", d="baseline_mape model_mape points")
def substitution(spark, sf):
    x = windowed(fr.demand(spark, sf), ["region"], "h", {"l": lambda w: F.lag("demand_mw", 24).over(w), "l2": lambda w: F.lag("demand_mw", 48).over(w)}, before=48)
    g = x.groupBy("region").agg(F.count("demand_mw").alias("n_hours"), mt.positive_mape("demand_mw", "l").alias("baseline_mape"), mt.positive_mape("demand_mw", "l2").alias("model_mape"))
    p = F.col("baseline_mape") - F.col("model_mape")
    return g.select("*", p.alias("points"), bl.serve_baseline(p, F.col("n_hours")).alias("decision"))


SAN = """recent AS (SELECT region, min(demand_mw) AS rmin, max(demand_mw) AS rmax, avg(demand_mw) AS rmean, count(*) AS rn FROM spine WHERE demand_mw > 20 GROUP BY region),
f AS (SELECT region, lead_hours, predicted * CASE WHEN region = 'click' THEN 1 + lead_hours / 200.0::DOUBLE ELSE 0.5 END + 60 AS predicted FROM naive),
p AS (SELECT f.*, prefix FROM f, (VALUES (24), (168), (720)) t(prefix) WHERE lead_hours <= prefix),
d AS (SELECT region, prefix, (lead_hours - 1) // 24 AS day, avg(predicted) AS m FROM p GROUP BY ALL),
dd AS (SELECT region, prefix, arg_min(m, day) AS a, arg_max(m, day) AS b, regr_r2(m, day) AS r2 FROM d GROUP BY ALL),
san AS (SELECT region, prefix, fmin, fmax, CASE WHEN rn IS NULL OR rn < 168 THEN NULL WHEN fmin < 0.5 * rmin THEN 'below_recent_band' WHEN fmax > 1.6 * rmax THEN 'above_recent_band'
  WHEN prefix >= 360 AND abs(b - a) > 0.4 * rmean AND r2 > 0.95 THEN 'sustained_drift' END AS reason
  FROM (SELECT region, prefix, min(predicted) AS fmin, max(predicted) AS fmax FROM p GROUP BY ALL) JOIN dd USING (region, prefix) LEFT JOIN recent USING (region))"""


def sanity_rows(spark, sf):
    grow = F.when(F.col("region") == "click", 1 + F.col("lead_hours") / 200).otherwise(0.5)
    f = naive(spark, sf).withColumn("predicted", F.col("predicted") * grow + 60)
    return bl.sanity(f, fr.demand(spark, sf).filter("demand_mw > 20"))


@query("b11_long_horizon_sanity", "spine", f"WITH {NAIVE}, {SAN} SELECT * FROM san", d="fmin fmax", i="prefix")
def sanity(spark, sf):
    return sanity_rows(spark, sf)


@query("b12_max_ok_horizon", "spine", f"""WITH {NAIVE}, {SAN}
SELECT region, coalesce(max(prefix) FILTER (reason IS NULL), 0) AS max_ok_horizon, min(prefix) FILTER (reason IS NOT NULL) AS flagged_horizon, arg_min(reason, prefix) FILTER (reason IS NOT NULL) AS reason FROM san GROUP BY region""",
       i="max_ok_horizon flagged_horizon")
def max_ok(spark, sf):
    return bl.max_ok_horizon(sanity_rows(spark, sf))


def featured_end(spark, sf):
    """Last featured hour per region: some hours before the end."""
    d = fr.hourly(spark, sf).groupBy("region").agg(F.max("ts").alias("m"))
    back = F.when(F.col("region") == "click", 0).when(F.col("region") == "view", 30).otherwise(100)
    return d.select("region", (F.col("m") - F.make_dt_interval(F.lit(0), back)).alias("last_featured_ts"))


FEND = "fend AS (SELECT region, max(ts) - to_hours(CASE region WHEN 'click' THEN 0 WHEN 'view' THEN 30 ELSE 100 END) AS last_featured_ts FROM hourly GROUP BY region)"
BRIDGE = """bridge AS (SELECT region, ts, demand_mw FROM (SELECT h.region, h.ts, demand_mw, epoch(h.ts - last_featured_ts) / 3600 AS k, row_number() OVER (PARTITION BY h.region ORDER BY h.ts) AS rn
  FROM hourly h JOIN fend USING (region) WHERE h.ts > last_featured_ts) WHERE k = rn)"""


@query("w17_contiguous_bridge", "hourly", f"WITH {FEND}, {BRIDGE} SELECT * FROM bridge")
def contiguous_bridge(spark, sf):
    return bl.bridge(featured_end(spark, sf), fr.hourly(spark, sf))


@query("u2_seed_concat", "hourly", f"WITH {FEND}, {BRIDGE} SELECT region, count(*) AS n, max(ts) AS last_ts FROM (SELECT region, ts FROM hourly JOIN fend USING (region) WHERE ts <= last_featured_ts UNION ALL SELECT region, ts FROM bridge) GROUP BY region")
def seed_concat(spark, sf):
    h, e = fr.hourly(spark, sf), featured_end(spark, sf)
    feat = h.join(e, "region").filter("ts <= last_featured_ts").select("region", "ts", "demand_mw")
    return feat.unionByName(bl.bridge(e, h)).groupBy("region").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


START = """start AS (SELECT f.region, CASE WHEN last_featured_ts < last_real AND e IS NOT NULL THEN e ELSE least(last_featured_ts, last_real) END + INTERVAL 1 HOUR AS forecast_start, last_real, last_featured_ts, coalesce(n, 0) AS bridge_hours
  FROM fend f JOIN (SELECT region, max(ts) AS last_real FROM hourly GROUP BY region) USING (region) LEFT JOIN (SELECT region, max(ts) AS e, count(*) AS n FROM bridge GROUP BY region) USING (region))"""


@query("g7_forecast_start", "hourly", f"""WITH {FEND}, {BRIDGE}, {START}
SELECT region, forecast_start, CASE WHEN forecast_start = last_real + INTERVAL 1 HOUR THEN 'real_demand' WHEN forecast_start = last_featured_ts + INTERVAL 1 HOUR THEN 'featured' ELSE 'featured_bridged' END AS binding_term, bridge_hours FROM start""")
def forecast_start(spark, sf):
    return bl.forecast_start(featured_end(spark, sf), fr.hourly(spark, sf))


@query("g8_anchor_provenance", "hourly", f"""WITH {FEND}, {BRIDGE}, {START}
SELECT s.region, forecast_start - INTERVAL 1 HOUR AS anchor_ts, round(CASE WHEN h.ts <= last_featured_ts THEN h.demand_mw + 0.25 WHEN hour(h.ts) % 2 = 0 THEN h.demand_mw + 1 ELSE h.demand_mw END, 2) AS anchor_mw,
  CASE WHEN s.region <> 'error' THEN hour(h.ts) % 3 = 0 END AS anchor_was_placeholder, CASE WHEN h.ts IS NOT NULL THEN hour(h.ts) % 2 = 0 END AS anchor_conditioned
FROM start s LEFT JOIN hourly h ON s.region = h.region AND h.ts = forecast_start - INTERVAL 1 HOUR""", d="anchor_mw")
def provenance(spark, sf):
    h = fr.hourly(spark, sf)
    cond = h.withColumn("demand_mw", F.col("demand_mw") + F.when(F.hour("ts") % 2 == 0, 1).otherwise(0))
    ph = h.filter("region <> 'error'").select("region", "ts", (F.hour("ts") % 3 == 0).alias("placeholder"))
    end = featured_end(spark, sf)
    featured = h.join(end, "region").filter("ts <= last_featured_ts").withColumn("demand_mw", F.col("demand_mw") + 0.25)
    return bl.anchor_provenance(bl.forecast_start(end, h), featured, h, cond, ph)


@query("w18_window_contiguity", "hourly", f"""WITH o AS (SELECT region, max(ts) + to_hours(CASE region WHEN 'view' THEN 3 ELSE 1 END) AS origin FROM hourly GROUP BY region),
h2 AS (SELECT * FROM hourly WHERE region <> 'error' OR ts < TIMESTAMP '2024-01-05'),
t AS (SELECT region, min(ts) AS a, max(ts) AS b, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS rn FROM h2) WHERE rn <= CASE region WHEN 'click' THEN 5 ELSE 168 END GROUP BY region)
SELECT region, CASE WHEN n < 168 THEN 'unusable' WHEN g = 0 AND epoch(b - a) / 3600 = 167 THEN 'identical' WHEN g > 0 THEN 'seed_tail_short' ELSE 'hole_in_lookback' END AS reason, g AS gap_hours
FROM (SELECT region, a, b, n, CAST(epoch(origin - b) / 3600 - 1 AS BIGINT) AS g FROM o JOIN t USING (region))""")
def contiguity(spark, sf):
    h = fr.hourly(spark, sf)
    o = h.groupBy("region").agg(F.max("ts").alias("m")).select("region", (F.col("m") + F.make_dt_interval(F.lit(0), F.when(F.col("region") == "view", 3).otherwise(1))).alias("origin"))
    few = newest(h.filter("region = 'click'"), ["region"], "ts", 5)
    stamps = few.unionByName(h.filter("region <> 'click' AND (region <> 'error' OR ts < '2024-01-05')"))
    return bl.window_contiguity(stamps, o)


BOUNDS = "b AS (SELECT region, max(ts) - INTERVAL 60 HOUR AS anchor_end, max(ts) - INTERVAL 20 HOUR AS start FROM spine GROUP BY region)"


def bounds(spark, sf):
    m = F.max("ts")
    return fr.hourly(spark, sf).groupBy("region").agg((m - hours(60)).alias("anchor_end"), (m - hours(20)).alias("start"))


@query("j22_gap_frame", "spine", f"""WITH {BOUNDS} SELECT region, ts, CASE WHEN ts < start THEN 'gap' ELSE 'future' END AS part FROM spine JOIN b USING (region) WHERE (ts > anchor_end AND ts < start) OR ts >= start""")
def gap_frame(spark, sf):
    d, b = fr.demand(spark, sf).select("region", "ts", "demand_mw"), bounds(spark, sf)
    future = d.join(b, "region").filter("ts >= start").select("region", "ts")
    return bl.gap_frame(d, future, b)


@query("j22_gap_actuals", "spine", f"""WITH {BOUNDS}, g AS (SELECT s.* FROM spine s JOIN b USING (region) WHERE ts > anchor_end AND ts < start)
SELECT region, ts, demand_mw FROM g WHERE ts < coalesce((SELECT min(ts) FROM g x WHERE x.region = g.region AND demand_mw IS NULL), TIMESTAMP '2100-01-01')""")
def gap_actuals(spark, sf):
    return bl.gap_actuals(fr.demand(spark, sf).select("region", "ts", "demand_mw"), bounds(spark, sf))


GATE_SQL = """anchors AS (SELECT region, mx - to_hours(24 * i) AS anchor FROM (SELECT region, max(ts) AS mx FROM spine GROUP BY region), (VALUES (0), (1), (2)) t(i)),
rec AS (SELECT a.region, anchor, avg(demand_mw) AS mean, count(*) AS n, quantile_cont(demand_mw, 0.05) AS p5 FROM anchors a JOIN spine s ON a.region = s.region AND s.ts <= anchor AND s.ts > anchor - INTERVAL 168 HOUR GROUP BY ALL),
pr AS (SELECT a.region, anchor, s.ts + INTERVAL 48 HOUR AS ts, s.demand_mw + 30 AS predicted FROM anchors a JOIN spine s ON a.region = s.region AND s.ts <= anchor AND s.ts > anchor - INTERVAL 48 HOUR WHERE s.demand_mw IS NOT NULL),
j AS (SELECT pr.*, t.demand_mw AS actual FROM pr LEFT JOIN spine t ON pr.region = t.region AND pr.ts = t.ts),
v AS (SELECT region, anchor, pmin / p5 AS trough_ratio, pmean / mean AS level_ratio, CASE WHEN nreal >= 12 THEN med END AS truth_median_ape,
  CASE WHEN nreal >= 12 THEN med <= 25 AND prmin / tmin >= 0.75 ELSE pmin / p5 >= 0.75 AND pmean / mean BETWEEN 0.75 AND 2.0 END AS ok
  FROM (SELECT region, anchor, min(predicted) AS pmin, avg(predicted) AS pmean, count(*) FILTER (actual > 0) AS nreal, min(predicted) FILTER (actual > 0) AS prmin, min(actual) FILTER (actual > 0) AS tmin,
    quantile_cont(CASE WHEN actual > 0 THEN abs(predicted - actual) / actual * 100 END, 0.5) AS med FROM j GROUP BY ALL) JOIN rec USING (region, anchor) WHERE n >= 168 AND p5 > 0 AND mean > 0)"""


def probe_verdicts(spark, sf):
    """Probe forecasts at three anchors a day apart: the values of two days before."""
    d = stored(fr.demand(spark, sf).select("region", "ts", "demand_mw"), "demand")
    marks = F.explode(F.sequence(F.lit(0), F.lit(bl.PROBE_ANCHORS - 1))).alias("i")
    a = d.groupBy("region").agg(F.max("ts").alias("m")).select("region", "m", marks).select(
        "region", (F.col("m") - F.make_dt_interval(F.lit(0), F.col("i") * bl.PROBE_STEP_HOURS)).alias("anchor"))
    x = d.join(a, "region").filter("ts <= anchor")
    recent = x.filter(F.col("ts") > F.col("anchor") - hours(168))
    p = x.filter((F.col("ts") > F.col("anchor") - hours(48)) & F.col("demand_mw").isNotNull()).select(
        "region", "anchor", (F.col("ts") + hours(48)).alias("ts"), (F.col("demand_mw") + 30).alias("predicted"))
    probes = p.join(d.withColumnRenamed("demand_mw", "actual"), ["region", "ts"], "left")
    return stored(bl.serve_gate(stored(probes, "probes"), stored(recent, "recent")), "verdicts")


@query("b13_serve_path_gate", "spine", f"WITH {GATE_SQL} SELECT * FROM v", d="trough_ratio level_ratio truth_median_ape")
def serve_gate(spark, sf):
    return probe_verdicts(spark, sf)


@query("b13_gate_decision", "spine", f"""WITH {GATE_SQL}
SELECT region, count(*) AS n_anchors, count(*) FILTER (NOT ok) AS n_failures, coalesce(bool_and(ok) FILTER (truth_median_ape IS NULL), true) AND count(*) FILTER (NOT ok) <= 1 AS passed FROM v GROUP BY region""")
def gate_decision(spark, sf):
    return bl.gate_decision(probe_verdicts(spark, sf))


# -- ensembles ---------------------------------------------------------------

WEIGHTS = SCORES + """, w AS (SELECT *, CASE WHEN ok THEN pow(1 / mape, 3) / sum(pow(1 / mape, 3)) OVER (PARTITION BY region) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY region) END AS weight, CASE WHEN ok THEN 'inverse_mape_cubed' ELSE 'equal' END AS rule
  FROM (SELECT region, model, CASE WHEN region <> 'view' OR model <> 'lag48' THEN mape END AS mape, bool_and(region <> 'view' OR model <> 'lag48') OVER (PARTITION BY region) AS ok FROM scores))"""


def member_scores(spark, sf):
    """One region misses a member's error, so the resolver falls back there."""
    return scores(spark, sf).withColumn("mape", F.when((F.col("region") != "view") | (F.col("model") != "lag48"), F.col("mape")))


@query("b6_ensemble_weights", "scored", f"WITH {WEIGHTS} SELECT region, model, mape, weight, rule FROM w", d="mape weight")
def ensemble_weights(spark, sf):
    return en.weights(member_scores(spark, sf), ["region"])


@query("b25c_ensemble_weights", "scored", f"""WITH {WEIGHTS}
SELECT region, 'ensemble_weights' AS metric, 'info' AS severity, first(model ORDER BY weight DESC, model) AS dominant,
  'Ensemble weights: ' || string_agg(model || ' ' || CAST(round(weight * 100) AS BIGINT) || '%', ', ' ORDER BY weight DESC, model) || ' \u2014 ' || first(model ORDER BY weight DESC, model) || ' dominates due to lowest individual MAPE.' AS text
FROM w GROUP BY region""")
def weight_insight(spark, sf):
    return ensemble_weight_insight(en.weights(member_scores(spark, sf), ["region"]))


@query("b6_usable_member_weights", "scored", f"""WITH {SCORES} SELECT region, model, mape, pow(1 / mape, 3) / sum(pow(1 / mape, 3)) OVER (PARTITION BY region) AS weight FROM scores WHERE region <> 'view' OR model <> 'lag48'""", d="mape weight")
def usable_weights(spark, sf):
    return en.usable_weights(member_scores(spark, sf), ["region"])


@query("b7_ensemble_combine", "scored", f"""WITH {WEIGHTS}
SELECT region, ts, sum(weight * predicted) / sum(weight) AS predicted, count(*) AS members, sum(weight * predicted) / sum(weight) BETWEEN min(predicted) - 1e-6 AND max(predicted) + 1e-6 AS within_members FROM scored JOIN w USING (region, model) GROUP BY ALL""", d="predicted")
def combine(spark, sf):
    return en.combine(fr.scored(spark, sf), en.weights(member_scores(spark, sf), ["region"]), ["region"], ["region", "ts"])


HOLD = """hold AS (SELECT * FROM scored QUALIFY count(*) OVER (PARTITION BY region, ts) = 3),
pos AS (SELECT *, dense_rank() OVER (PARTITION BY region ORDER BY ts) - 1 AS pos, CAST(floor((SELECT count(DISTINCT ts) FROM hold x WHERE x.region = hold.region) * 0.5) AS BIGINT) AS split FROM hold),
sc AS (SELECT region, model, avg(abs((actual - predicted) / actual)) AS full_m, avg(abs((actual - predicted) / actual)) FILTER (pos < split) AS fit_m FROM pos GROUP BY ALL),
wt AS (SELECT region, model, pow(1 / fit_m, 3) / sum(pow(1 / fit_m, 3)) OVER (PARTITION BY region) AS wf FROM sc),
wu AS (SELECT region, model, pow(1 / full_m, 3) / sum(pow(1 / full_m, 3)) OVER (PARTITION BY region) AS wa FROM sc),
ens AS (SELECT region, ts, any_value(actual) AS actual, bool_or(big) AS big, CASE WHEN bool_or(big) THEN sum(wf * predicted) ELSE sum(wa * predicted) END AS predicted
  FROM (SELECT *, split >= 24 AND max(pos) OVER (PARTITION BY region) + 1 - split >= 24 AS big FROM pos) JOIN wt USING (region, model) JOIN wu USING (region, model) WHERE NOT big OR pos >= split GROUP BY 1, 2)"""


@query("b8_holdout_ensemble_score", "scored", f"""WITH {HOLD}
SELECT region, 'inverse_mape_cubed' AS weight_rule, CASE WHEN big THEN 'out_of_sample' ELSE 'in_sample' END AS scored, avg(abs((actual - predicted) / actual)) * 100 AS mape, sqrt(avg(pow(actual - predicted, 2))) AS rmse, avg(abs(actual - predicted)) AS mae,
  CASE WHEN var_pop(actual) * count(*) < 1e-10 THEN 0 ELSE 1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)) END AS r2, count(*) AS n FROM ens GROUP BY region, big""", d="mape rmse mae r2")
def holdout_score(spark, sf):
    s = stored(fr.scored(spark, sf).select("region", "model", "ts", "actual", "predicted"), "scored")
    whole = s.groupBy("region", "ts").agg(F.count("*").alias("n")).filter("n = 3").select("region", "ts")
    return en.holdout_score(stored(s.join(whole, ["region", "ts"], "left_semi"), "holdout"))


@query("w21_ewma", "", f"""WITH RECURSIVE m AS (SELECT region, model, trained_at, mape, row_number() OVER (PARTITION BY region, model ORDER BY trained_at) AS k
  FROM (SELECT region, model, trained_at, max(mape) AS mape FROM ({METADATA_SQL}) WHERE trained_at IS NOT NULL GROUP BY ALL)),
e AS (SELECT region, model, trained_at, k, mape AS ewma FROM m WHERE k = 1 UNION ALL SELECT m.region, m.model, m.trained_at, m.k, 0.3::DOUBLE * m.mape + 0.7::DOUBLE * e.ewma FROM e JOIN m ON e.region = m.region AND e.model = m.model AND m.k = e.k + 1)
SELECT region, model, trained_at, ewma FROM e""", d="ewma")
def ewma(spark, sf):
    return smoothed(spark, sf).select("region", "model", "trained_at", "ewma")


def smoothed(spark, sf):
    h = metadata(spark, sf).filter("trained_at IS NOT NULL").groupBy("region", "model", "trained_at").agg(F.max("mape").alias("mape"))
    return en.ewma(h.withColumn("t", hour_number("trained_at")), ["region", "model"], "t", "mape")


@query("b9_weighting_input", "", f"""
SELECT region, model, trained_at, mape, mape_ewma, coalesce(mape_ewma, mape) AS weighting_mape, CASE WHEN mape_ewma IS NOT NULL THEN 'mape_ewma' ELSE 'holdout_mape' END AS weight_input, mape AS shadow_mape
FROM (SELECT region, model, trained_at, mape, CASE WHEN CAST(version AS BIGINT) % 3 <> 0 THEN mape * 0.9::DOUBLE END AS mape_ewma FROM ({METADATA_SQL}))""", d="mape mape_ewma weighting_mape shadow_mape")
def weighting_input(spark, sf):
    m = metadata(spark, sf).withColumn("mape_ewma", F.when(F.col("version").cast("long") % 3 != 0, F.col("mape") * 0.9)).drop("version")
    return en.weighting_input(m)


@query("j19_latest_before_origin", "", f"""
WITH h AS (SELECT region, model, trained_at, max(mape) AS mape FROM ({METADATA_SQL}) WHERE trained_at IS NOT NULL GROUP BY ALL),
o AS (SELECT DISTINCT region, model, trained_at AS origin FROM ({METADATA_SQL}) WHERE trained_at IS NOT NULL)
SELECT o.region, o.model, origin, h.trained_at, h.mape FROM o LEFT JOIN h ON o.region = h.region AND o.model = h.model AND h.trained_at < o.origin QUALIFY row_number() OVER (PARTITION BY o.region, o.model, origin ORDER BY h.trained_at DESC NULLS LAST) = 1""", d="mape")
def latest_before(spark, sf):
    m = metadata(spark, sf).filter("trained_at IS NOT NULL")
    h = m.select("region", "model", "trained_at", "mape")
    o = m.select("region", "model", F.col("trained_at").alias("origin")).distinct()
    return en.latest_before(o, h, ["region", "model"])


# -- windows and verdicts ------------------------------------------------------

DELTAS = """weekly AS (SELECT region, model, CAST(epoch(ts) / 3600 AS BIGINT) // 84 AS wk, avg(abs(actual - predicted) / actual) * 100 AS m FROM scored GROUP BY ALL),
dl AS (SELECT a.region, b.model, a.wk, a.m - b.m AS delta FROM weekly a JOIN weekly b USING (region, wk) WHERE a.model = 'lag24' AND b.model <> 'lag24')"""


def deltas(spark, sf):
    w = fr.scored(spark, sf).groupBy("region", "model", F.floor(hour_number("ts") / 84).alias("wk")).agg((F.avg(mt.ape())).alias("m"))
    c = w.filter("model = 'lag24'").select("region", "wk", F.col("m").alias("c"))
    return w.filter("model <> 'lag24'").join(c, ["region", "wk"]).select("region", "model", "wk", (F.col("c") - F.col("m")).alias("delta"))


@query("b14_paired_verdict", "scored", f"""WITH {DELTAS},
g AS (SELECT region, model, count(*) AS n, avg(delta) AS mean, quantile_cont(delta, 0.5) AS median, min(delta) AS worst_window, max(delta) AS best_window, stddev_samp(delta) / sqrt(count(*)) AS stderr,
  count(*) FILTER (sign(delta) = sign(mu)) / count(*) AS sign_consistency FROM (SELECT *, avg(delta) OVER (PARTITION BY region, model) AS mu FROM dl) GROUP BY ALL),
r AS (SELECT *, mean / stderr AS t, CASE WHEN n < 4 THEN 'too_few_windows' WHEN mean = 0 THEN 'no_difference' WHEN median <> 0 AND sign(mean) <> sign(median) THEN 'mean_median_disagree'
  WHEN stderr > 0 AND abs(mean) < 2 * stderr THEN 'within_noise' WHEN sign_consistency < 0.75 THEN 'not_consistent' ELSE 'decisive' END AS reason FROM g)
SELECT region, model, n, mean, median, worst_window, best_window, CASE WHEN n >= 4 THEN stderr END AS stderr, CASE WHEN n >= 4 THEN t END AS t, CASE WHEN n >= 4 THEN sign_consistency END AS sign_consistency, reason, reason = 'decisive' AS decisive,
  CASE WHEN reason = 'decisive' THEN CASE WHEN mean > 0 THEN 'treatment' ELSE 'control' END END AS winner FROM r""", d="mean median worst_window best_window stderr t sign_consistency")
def paired_verdict(spark, sf):
    return mt.paired_verdict(deltas(spark, sf), ["region", "model"])


@query("b15_satisficing_check", "scored", """
WITH m AS (SELECT region, model, avg(abs(actual - predicted) / (actual + 2000)) * 100 AS mape, avg((predicted - actual) / (actual + 500)) * 100 AS bias FROM scored GROUP BY ALL)
SELECT b.region, b.model, concat_ws(',', CASE WHEN b.bias < -2 THEN 'under-forecasting' WHEN b.bias > 2 THEN 'over-forecasting' END, CASE WHEN b.mape - a.mape > 0.5 THEN 'mape regression' END) AS failures
FROM m a JOIN m b USING (region) WHERE a.model = 'lag24' AND b.model <> 'lag24'""")
def satisficing(spark, sf):
    err = F.col("actual") - F.col("predicted")
    m = fr.scored(spark, sf).groupBy("region", "model").agg((F.avg(F.abs(err) / (F.col("actual") + 2000)) * 100).alias("mape"), (F.avg(-err / (F.col("actual") + 500)) * 100).alias("bias"))
    c = m.filter("model = 'lag24'").select("region", F.col("mape").alias("control"))
    return m.filter("model <> 'lag24'").join(c, "region").select("region", "model", F.array_join(mt.satisficing("bias", "control", "mape"), ",").alias("failures"))


@query("a43_binned_cells", "scored", """
SELECT bin, count(*) AS n, avg(delta) AS mean, avg((delta > 0)::INT) AS win_rate, quantile_cont(delta, 0.5) AS median FROM (SELECT CASE WHEN hour(ts) <= 5 THEN '0-5' WHEN hour(ts) <= 11 THEN '6-11' WHEN hour(ts) <= 17 THEN '12-17' ELSE '18-23' END AS bin,
  abs(a.actual - a.predicted) - abs(b.actual - b.predicted) AS delta FROM scored a JOIN scored b USING (region, ts) WHERE a.model = 'lag24' AND b.model = 'lag168') GROUP BY bin""", d="mean win_rate median")
def binned(spark, sf):
    bins = [("0-5", (0, 5)), ("6-11", (6, 11)), ("12-17", (12, 17)), ("18-23", (18, 23))]
    return bt.binned_cells(arm_deltas(spark, sf).withColumn("hour", F.hour("ts")), "hour", bins)


def arm_deltas(spark, sf):
    """Error of the daily arm minus the weekly arm, per region and hour."""
    err = F.abs(F.col("actual") - F.col("predicted"))
    return fr.scored(spark, sf).filter("model <> 'lag48'").groupBy("region", "ts").agg(
        (F.max(F.when(F.col("model") == "lag24", err)) - F.max(F.when(F.col("model") == "lag168", err))).alias("delta")).filter("delta IS NOT NULL")


@query("a44_bootstrap_mean_interval", "scored", """
WITH x AS (SELECT region, CAST(epoch(ts) / 3600 AS BIGINT) AS id, max(abs(actual - predicted)) FILTER (model = 'lag24') - max(abs(actual - predicted)) FILTER (model = 'lag168') AS delta
  FROM scored WHERE model <> 'lag48' GROUP BY region, ts),
y AS (SELECT region, delta, b, (CAST('0x' || substr(md5(id || '|' || b), 1, 8) AS BIGINT) % 1000003 + 0.5::DOUBLE) / 1000003 AS u FROM x, generate_series(1, 200) s(b) WHERE delta IS NOT NULL),
k AS (SELECT *, list_sum(list_transform([0.36787944117144233::DOUBLE, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119], lambda c: CASE WHEN u > c THEN 1 ELSE 0 END)) AS k FROM y),
m AS (SELECT region, b, sum(delta * k) / nullif(sum(k), 0) AS m FROM k GROUP BY region, b)
SELECT region, avg(delta) AS mean, count(*) AS n, any_value(lo) AS ci_low, any_value(hi) AS ci_high FROM x
JOIN (SELECT region, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY region) USING (region) WHERE delta IS NOT NULL GROUP BY region""", d="mean ci_low ci_high")
def bootstrap(spark, sf):
    x = arm_deltas(spark, sf).withColumn("id", hour_number("ts"))
    return bt.bootstrap_mean(x, ["region"], "delta", "id")


# -- folds and intervals -------------------------------------------------------

def rows(spark, sf):
    h = fr.hourly(spark, sf).withColumn("o", hour_number("ts"))
    return with_position(h, ["region"], "o").drop("o")


def sizes(hourly):
    return hourly.groupBy("region").agg(F.count("*").alias("n"))


@query("g4_rolling_origin_splits", "hourly", """
SELECT region, n, fold, n - fold * 48 - 72 AS test_start, n - fold * 48 AS test_end FROM (SELECT region, count(*) AS n FROM hourly GROUP BY region), (SELECT unnest(generate_series(0, 11)) AS fold) WHERE n - fold * 48 - 72 >= 300""")
def rolling_splits(spark, sf):
    return bt.rolling_splits(sizes(fr.hourly(spark, sf)), 12, 72, 300, 48)


FOLDS = """sz AS (SELECT region, count(*) AS n FROM hourly GROUP BY region), fo AS (SELECT region, n, fold, nf AS n_folds, n - (nf - fold + 1) * 48 AS test_start, n - (nf - fold) * 48 AS test_end
  FROM (SELECT *, least(5, greatest(1, (n - 400) // 48)) AS nf FROM sz WHERE n >= 448), (SELECT unnest(generate_series(1, 5)) AS fold) WHERE fold <= nf),
pr AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS pos FROM hourly)"""


def folds(hourly):
    return bt.walk_forward_folds(sizes(hourly), 48, 400)


@query("g5_walk_forward_folds", "hourly", f"WITH {FOLDS} SELECT * FROM fo")
def walk_forward(spark, sf):
    return folds(fr.hourly(spark, sf))


ARMS = FOLDS + """, te AS (SELECT p.*, f.fold, f.test_start, f.test_end FROM pr p JOIN fo f ON p.region = f.region AND pos >= test_start AND pos < test_end),
nv AS (SELECT te.region, te.fold, te.ts, te.demand_mw AS actual, s.demand_mw AS predicted, 'naive' AS model FROM te JOIN pr s ON te.region = s.region AND s.pos = te.pos - 24 * CAST(ceil((te.pos - test_start + 1) / 24) AS BIGINT)),
tr AS (SELECT f.region, fold, isodow(ts) AS dow, hour(ts) AS hour, demand_mw FROM fo f JOIN pr p ON p.region = f.region AND pos < test_start),
c1 AS (SELECT region, fold, dow, hour, avg(demand_mw) AS m FROM tr GROUP BY ALL), c2 AS (SELECT region, fold, hour, avg(demand_mw) AS m FROM tr GROUP BY ALL), c3 AS (SELECT region, fold, avg(demand_mw) AS m FROM tr GROUP BY ALL),
cl AS (SELECT te.region, te.fold, te.ts, te.demand_mw AS actual, coalesce(c1.m, c2.m, c3.m) AS predicted, 'climatology' AS model FROM te LEFT JOIN c1 ON te.region = c1.region AND te.fold = c1.fold AND isodow(ts) = c1.dow AND hour(ts) = c1.hour
  LEFT JOIN c2 ON te.region = c2.region AND te.fold = c2.fold AND hour(ts) = c2.hour LEFT JOIN c3 ON te.region = c3.region AND te.fold = c3.fold),
arms AS (SELECT * FROM nv UNION ALL SELECT * FROM cl),
rs AS (SELECT * FROM arms QUALIFY row_number() OVER (PARTITION BY region, model ORDER BY ts DESC) <= 240),
cal AS (SELECT a.*, predicted + lo AS lower, predicted + up AS upper FROM arms a JOIN (SELECT region, model, quantile_cont(actual - predicted, 0.1) AS lo, quantile_cont(actual - predicted, 0.9) AS up FROM rs GROUP BY ALL) USING (region, model))"""


def arms(spark, sf):
    """Both arms on the test rows of every fold, from one stored pass over positions."""
    r = stored(rows(spark, sf), "positions")
    f = stored(folds(r), "folds")
    cols = ["region", "fold", "ts", F.col("demand_mw").alias("actual"), "predicted"]
    nv = bt.naive_arm(r, f).select(*cols, F.lit("naive").alias("model"))
    return stored(nv.unionByName(bt.climatology_arm(r, f).select(*cols, F.lit("climatology").alias("model"))), "arms")


@query("b17_walk_forward_predictions", "hourly", f"WITH {ARMS} SELECT region, model, fold, ts, actual, predicted, lower, upper FROM cal", d="predicted lower upper")
def walk_predictions(spark, sf):
    return bt.calibrated(arms(spark, sf), ["region", "model"], 48).drop("sample_size")


@query("b17_walk_forward_summary", "hourly", f"""WITH {ARMS}
SELECT region, model, avg(abs((actual - predicted) / actual)) * 100 AS mape, sqrt(avg(pow(actual - predicted, 2))) AS rmse, avg(abs(actual - predicted)) AS mae, 1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)) AS r2,
  avg((actual >= lower AND actual <= upper)::INT) AS coverage, count(DISTINCT fold) AS num_folds, count(*) AS n FROM cal GROUP BY ALL""", d="mape rmse mae r2 coverage")
def walk_summary(spark, sf):
    return bt.backtest_summary(bt.calibrated(arms(spark, sf), ["region", "model"], 48), ["region", "model"])


EXOG = FOLDS + """, wr AS (SELECT pr.*, temperature_2m FROM pr LEFT JOIN weather USING (region, ts)),
te AS (SELECT p.*, f.fold, f.test_start FROM wr p JOIN fo f ON p.region = f.region AND pos >= test_start AND pos < test_end),
tr AS (SELECT f.region, fold, isodow(ts) AS dow, hour(ts) AS hour, temperature_2m AS t FROM fo f JOIN wr p ON p.region = f.region AND pos < test_start),
c1 AS (SELECT region, fold, dow, hour, avg(t) AS m FROM tr GROUP BY ALL), c2 AS (SELECT region, fold, hour, avg(t) AS m FROM tr GROUP BY ALL), c3 AS (SELECT region, fold, avg(t) AS m FROM tr GROUP BY ALL),
ar AS (SELECT region, ts, temperature_2m + 2 AS a FROM weather WHERE cloud_cover > 15),
x AS (SELECT te.region, te.fold, te.ts, te.pos, a, coalesce(c1.m, c2.m, c3.m) AS c, avg((a IS NOT NULL)::INT) OVER (PARTITION BY te.region, te.fold) AS cov FROM te LEFT JOIN ar USING (region, ts)
  LEFT JOIN c1 ON te.region = c1.region AND te.fold = c1.fold AND isodow(te.ts) = c1.dow AND hour(te.ts) = c1.hour LEFT JOIN c2 ON te.region = c2.region AND te.fold = c2.fold AND hour(te.ts) = c2.hour LEFT JOIN c3 ON te.region = c3.region AND te.fold = c3.fold)
SELECT region, fold, ts, CASE WHEN cov >= 0.8 THEN 'archived forecast snapshot' ELSE 'climatology/naive baseline' END AS source, CASE WHEN cov >= 0.8 THEN coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY region, fold ORDER BY pos ROWS UNBOUNDED PRECEDING),
  first_value(a IGNORE NULLS) OVER (PARTITION BY region, fold ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) ELSE c END AS temperature_2m FROM x"""


@query("j24_fold_weather_overlay", "hourly weather", "WITH " + EXOG, d="temperature_2m")
def fold_weather(spark, sf):
    w = stored(fr.weather(spark, sf).select("region", "ts", "temperature_2m", "cloud_cover"), "weather")
    r = stored(rows(spark, sf).join(w.select("region", "ts", "temperature_2m"), ["region", "ts"], "left"), "positions")
    archived = w.filter("cloud_cover > 15").select("region", "ts", (F.col("temperature_2m") + 2).alias("temperature_2m"))
    return bt.fold_exogenous(r, stored(folds(r), "folds"), archived, ["temperature_2m"])


RES = """res AS (SELECT region, horizon, ts, (actual - predicted) * sqrt(horizon / 24.0::DOUBLE) AS residual FROM scored, (VALUES (24), (168), (720)) t(horizon) WHERE model = 'lag24'),
anc AS (SELECT region, horizon, greatest(1, horizon // 2) AS effective_lead, quantile_cont(residual, 0.1) AS lower_error, quantile_cont(residual, 0.9) AS upper_error, count(*) AS sample_size
  FROM (SELECT *, row_number() OVER (PARTITION BY region, horizon ORDER BY ts DESC) AS rn, count(*) OVER (PARTITION BY region, horizon) AS nall FROM res) WHERE rn <= greatest(horizon * 5, 120) AND nall >= greatest(24, horizon // 2) GROUP BY ALL)"""


def anchors(spark, sf):
    hs = F.explode(F.array(*[F.lit(h) for h in bt.ANCHOR_HORIZONS]))
    r = fr.scored(spark, sf).filter("model = 'lag24'").select("region", "ts", (F.col("actual") - F.col("predicted")).alias("r"), hs.alias("horizon"))
    residuals = stored(r.select("region", "ts", "horizon", (F.col("r") * F.sqrt(F.col("horizon") / 24)).alias("residual")), "residuals")
    return stored(bt.interval_anchors(residuals, ["region"], "ts"), "anchors")


@query("w20_calibration_tail", "scored", f"WITH {RES} SELECT * FROM anc", d="lower_error upper_error", i="horizon effective_lead")
def calibration_tail(spark, sf):
    return anchors(spark, sf)


@query("w19_widening_interval", "scored spine", f"""WITH {RES}, {NAIVE},
l AS (SELECT n.region, ts, lead_hours, predicted, CASE WHEN lead_hours <= 12 THEN a.lower_error WHEN lead_hours <= 84 THEN a.lower_error + (b.lower_error - a.lower_error) * (lead_hours - 12) / 72.0::DOUBLE WHEN lead_hours <= 360 THEN b.lower_error + (c.lower_error - b.lower_error) * (lead_hours - 84) / 276.0::DOUBLE ELSE c.lower_error END AS lo,
  CASE WHEN lead_hours <= 12 THEN a.upper_error WHEN lead_hours <= 84 THEN a.upper_error + (b.upper_error - a.upper_error) * (lead_hours - 12) / 72.0::DOUBLE WHEN lead_hours <= 360 THEN b.upper_error + (c.upper_error - b.upper_error) * (lead_hours - 84) / 276.0::DOUBLE ELSE c.upper_error END AS up
  FROM naive n JOIN anc a ON a.region = n.region AND a.horizon = 24 JOIN anc b ON b.region = n.region AND b.horizon = 168 JOIN anc c ON c.region = n.region AND c.horizon = 720),
m AS (SELECT *, min(lo) OVER w AS lo_err, max(up) OVER w AS up_err FROM l WINDOW w AS (PARTITION BY region ORDER BY lead_hours ROWS UNBOUNDED PRECEDING))
SELECT region, ts, lead_hours, predicted, greatest(predicted + lo_err, 0) AS lower, greatest(predicted + up_err, greatest(predicted + lo_err, 0)) AS upper FROM m""", d="predicted lower upper")
def widening(spark, sf):
    return bt.widening_interval(stored(naive(spark, sf), "naive"), anchors(spark, sf))


@query("f23_indicative_half_width", "spine", f"WITH {NAIVE} SELECT region, ts, predicted * (1 - w) AS lower, predicted * (1 + w) AS upper FROM (SELECT *, CASE WHEN lead_hours <= 24 THEN 0.03::DOUBLE WHEN lead_hours <= 168 THEN 0.06 ELSE 0.10 END AS w FROM naive)", d="lower upper")
def half_width(spark, sf):
    w = bt.indicative_half_width(F.col("lead_hours"))
    return naive(spark, sf).select("region", "ts", (F.col("predicted") * (1 - w)).alias("lower"), (F.col("predicted") * (1 + w)).alias("upper"))


@query("a49_bottom_up_top_down", "scored", """
WITH z AS (SELECT ts, CAST(epoch(ts) / 3600 AS BIGINT) // 168 AS window_no, sum(predicted) AS bottom_up, sum(actual) AS actual FROM scored WHERE model = 'lag24' GROUP BY ts),
t AS (SELECT ts, sum(predicted) * 1.02::DOUBLE AS top_down FROM scored WHERE model = 'lag48' GROUP BY ts)
SELECT window_no, sum(abs(actual - bottom_up)) / sum(actual) * 100 AS wape_bottom_up, sum(abs(actual - top_down)) / sum(actual) * 100 AS wape_top_down, avg((bottom_up - actual) / actual) * 100 AS bias_bottom_up, avg((top_down - actual) / actual) * 100 AS bias_top_down, count(*) AS n
FROM z JOIN t USING (ts) GROUP BY window_no""", d="wape_bottom_up wape_top_down bias_bottom_up bias_top_down")
def bottom_up(spark, sf):
    s = fr.scored(spark, sf).withColumn("window_no", F.floor(hour_number("ts") / 168))
    direct = s.filter("model = 'lag48'").groupBy("window_no", "ts").agg((F.sum("predicted") * 1.02).alias("predicted"))
    return bt.bottom_up(s.filter("model = 'lag24'"), direct)


# -- calendar and simple windows ---------------------------------------------

@query("g2_future_calendar", "hourly", """
SELECT region, ts, hour(ts) AS hour, isodow(ts) - 1 AS dow, month(ts) AS month, dayofyear(ts) AS doy, isodow(ts) >= 6 AS is_weekend, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos, CASE WHEN strftime(ts, '%m-%d') = '02-19' THEN 1.0 ELSE 0.0 END AS is_holiday
FROM (SELECT region, unnest(generate_series(max(ts) + INTERVAL 1 HOUR, max(ts) + INTERVAL 720 HOUR, INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY region)""", d="hour_sin hour_cos dow_sin dow_cos is_holiday", i="hour dow month doy")
def future_calendar(spark, sf):
    last = fr.hourly(spark, sf).groupBy("region").agg(F.max("ts").alias("m"))
    f = last.select("region", F.explode(F.sequence(F.col("m") + hours(1), F.col("m") + hours(720), F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    return cal.with_holiday_flag(f.select("region", "ts", *[c.alias(n) for n, c in cal.calendar_columns("ts").items()]))


@query("g3_hourly_resample_mean", "", "SELECT event_type AS region, date_trunc('hour', ts) AS ts, avg(value) AS mean_mw FROM events GROUP BY 1, 2", d="mean_mw")
def resample(spark, sf):
    return fr.events(spark, sf).groupBy(F.col("event_type").alias("region"), F.window("ts", "1 hour")).agg(F.avg("value").alias("mean_mw")).select("region", F.col("window.start").alias("ts"), "mean_mw")


@query("w9_anomaly_band", "spine", """
SELECT region, ts, demand_mw, mean + 2 * sd AS upper, mean - 2 * sd AS lower, coalesce(demand_mw > mean + 2 * sd, false) AS anomaly FROM (SELECT *, avg(demand_mw) OVER w AS mean, stddev_samp(demand_mw) OVER w AS sd, row_number() OVER (PARTITION BY region ORDER BY h DESC) AS rn
  FROM spine WINDOW w AS (PARTITION BY region ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE rn <= 168""", d="upper lower")
def anomaly_band(spark, sf):
    x = windowed(fr.demand(spark, sf), ["region"], "h", {
        "mean": lambda w: F.avg("demand_mw").over(w.rowsBetween(-23, 0)), "sd": lambda w: F.stddev_samp("demand_mw").over(w.rowsBetween(-23, 0))}, before=23)
    up = F.col("mean") + 2 * F.col("sd")
    return newest(x, ["region"], "ts", 168).select("region", "ts", "demand_mw", up.alias("upper"), (F.col("mean") - 2 * F.col("sd")).alias("lower"), F.coalesce(F.col("demand_mw") > up, F.lit(False)).alias("anomaly"))


@query("w12_centered_trend", "spine", """
SELECT region, ts, CASE WHEN n = 168 THEN m END AS trend, CASE WHEN n = 168 THEN f - m END AS residual FROM (SELECT region, ts, f, avg(f) OVER w AS m, count(f) OVER w AS n FROM (SELECT *, coalesce(demand_mw, 100) AS f FROM spine)
WINDOW w AS (PARTITION BY region ORDER BY h ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING))""", d="trend residual")
def centered(spark, sf):
    v = F.coalesce("demand_mw", F.lit(100.0))
    x = windowed(fr.demand(spark, sf).withColumn("f", v), ["region"], "h", {
        "m": lambda w: F.avg("f").over(w.rowsBetween(-84, 83)), "n": lambda w: F.count("f").over(w.rowsBetween(-84, 83))}, before=84, after=83)
    trend = F.when(F.col("n") == 168, F.col("m"))
    return x.select("region", "ts", trend.alias("trend"), (F.col("f") - trend).alias("residual"))


@query("w15_peak_low_last_rows", "hourly", "SELECT region, max(demand_mw) AS peak, min(demand_mw) AS low, avg(demand_mw) AS mean FROM (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY region ORDER BY ts DESC) <= 168) GROUP BY region", d="mean")
def peak_low(spark, sf):
    return newest(fr.hourly(spark, sf), ["region"], "ts", 168).groupBy("region").agg(F.max("demand_mw").alias("peak"), F.min("demand_mw").alias("low"), F.avg("demand_mw").alias("mean"))


@query("w16_latest_real_reading", "spine", "SELECT region, max(demand_mw) FILTER (rn = 1) AS latest, max(demand_mw) FILTER (rn = 4) AS third_before FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS rn FROM spine WHERE demand_mw > 0) GROUP BY region")
def latest_real(spark, sf):
    x = newest(fr.demand(spark, sf).filter("demand_mw > 0"), ["region"], "ts", 4, "rn")
    return x.groupBy("region").agg(F.max(F.when(F.col("rn") == 1, F.col("demand_mw"))).alias("latest"), F.max(F.when(F.col("rn") == 4, F.col("demand_mw"))).alias("third_before"))


@query("w26_latest_weather_row", "weather", "SELECT region, arg_max(temperature_2m, ts) AS temperature_2m, arg_max(wind_speed_80m, ts) AS wind_speed_80m, arg_max(cloud_cover, ts) AS cloud_cover, max(ts) AS ts FROM weather GROUP BY region")
def latest_weather(spark, sf):
    cols = ["temperature_2m", "wind_speed_80m", "cloud_cover"]
    return fr.weather(spark, sf).groupBy("region").agg(F.max_by(F.struct("ts", *cols), "ts").alias("r")).select("region", "r.*")


@query("w22_outlier_ticks", "", """
WITH t AS (SELECT date_trunc('hour', ts) AS tick, sum(value) AS elapsed FROM events GROUP BY 1) SELECT tick, elapsed FROM t WHERE elapsed >= 1.5 * (SELECT quantile_cont(elapsed, 0.5) FROM t) AND (SELECT count(*) FROM t) >= 3""", d="elapsed")
def outlier_ticks(spark, sf):
    t = fr.events(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("tick")).agg(F.sum("value").alias("elapsed"))
    med = percentiles(t, [], {"med": (F.col("elapsed"), 0.5)})
    n = t.agg(F.count("*"))
    return t.filter((n.scalar() >= 3) & (F.col("elapsed") >= 1.5 * med.scalar()))


@query("w23_breach_streak", "hourly", """
SELECT region, count(*) AS streak, count(*) >= 3 AS alert FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts DESC) AS rn, sum((demand_mw <= 20)::INT) OVER (PARTITION BY region ORDER BY ts DESC) AS ok FROM hourly) WHERE ok = 0 GROUP BY region""")
def breach_streak(spark, sf):
    """Rows newer than the newest unbreached one."""
    h = fr.hourly(spark, sf)
    last_ok = h.groupBy("region").agg(F.max(F.when(F.col("demand_mw") <= 20, F.col("ts"))).alias("ok"))
    return h.join(last_ok, "region").filter("ok IS NULL OR ts > ok").groupBy("region").agg(F.count("*").alias("streak")).withColumn("alert", F.col("streak") >= 3)
