"""Learning, attribution, shadow-arm and downsampling queries."""

from pyspark.sql import functions as F

from loadstone.functions import calendar as cal
from loadstone.operators import benchmark as bm
from loadstone.operators import downsample as ds
from loadstone.operators import ensemble as en
from loadstone.operators import learn as ln
from loadstone.operators import linear as li
from loadstone.operators import metrics as mt
from loadstone.operators import ranking as rk
from loadstone.operators import shadow as sh
from loadstone.operators.features import AUTOREGRESSIVE
from loadstone.operators.series import hour_number, windowed
from loadstone.plans import frames as fr
from loadstone.plans.q_features import DERIVED_D, DERIVED_SQL, ROLL_D, _range_sql
from loadstone.plans.registry import query
from loadstone.session import reliable_checkpoint, stored

EXOG = ["temperature_2m", "cloud_cover", "hour_sin", "hour_cos"]
HORIZONS = (1, 6, 24, 72, 168)


def direct(spark, sf):
    m = fr.merged(spark, sf)
    m = m.select("region", "ts", "h", "demand_mw", "temperature_2m", "cloud_cover", *[cal.cyclical("ts")[c].alias(c) for c in ("hour_sin", "hour_cos")])
    return ln.direct_table(m, EXOG, HORIZONS)


@query("j21_direct_training_table", "merged", f"""
WITH snap AS (SELECT region, h AS origin_h, demand_lag_1h, demand_lag_3h, demand_lag_24h, demand_lag_168h, demand_lag_1h - demand_lag_2h AS ramp_rate, {', '.join(ROLL_D.split())}, {DERIVED_SQL}
  FROM (SELECT region, h, {_range_sql()} FROM spine)),
o AS (SELECT s.* FROM snap s JOIN (SELECT region, min(h) AS h0 FROM spine GROUP BY region) USING (region) WHERE origin_h - h0 >= 168 AND (origin_h - h0 - 168) % 12 = 0)
SELECT o.*, horizon_h, ts, temperature_2m, cloud_cover, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, demand_mw AS target
FROM o, (VALUES (1), (6), (24), (72), (168)) t(horizon_h) JOIN merged m ON m.region = o.region AND m.h = origin_h + horizon_h - 1""",
       d="ramp_rate " + ROLL_D + " " + DERIVED_D + " temperature_2m cloud_cover hour_sin hour_cos target", i="horizon_h")
def direct_table(spark, sf):
    return direct(spark, sf)


FEATURES = [*AUTOREGRESSIVE, "horizon_h", *EXOG]


def _training(spark, sf):
    """The training table, written once: fitting reads it many times."""
    return reliable_checkpoint(ln.prepared(direct(spark, sf).na.drop(subset=["target"]), FEATURES))


@query("b18_pooled_forecaster")
def pooled(spark, sf):
    """Error per region and horizon on the newest fifth of the origins."""
    t = _training(spark, sf)
    cut = ln.time_folds(t, "origin_h", 4)[-1][0]
    model = ln.pooled_forecaster(FEATURES).fit(t.filter(F.col("origin_h") < cut))
    test = model.transform(t.filter(F.col("origin_h") >= cut))
    return test.groupBy("region", "horizon_h").agg(mt.mape("target", "predicted").alias("mape"), mt.mae("target", "predicted").alias("mae"), F.count("*").alias("n"))


@query("b18_time_ordered_cv")
def pooled_cv(spark, sf):
    return ln.cross_validate(_training(spark, sf), FEATURES, "origin_h", 5, max_iter=4, max_depth=3)


LINEAR = ["demand_lag_24h", "temperature_2m"]
LINEAR_SQL = f"""WITH snap AS (SELECT region, h AS origin_h, demand_lag_24h FROM (SELECT region, h, {_range_sql()} FROM spine)),
o AS (SELECT s.* FROM snap s JOIN (SELECT region, min(h) AS h0 FROM spine GROUP BY region) USING (region) WHERE origin_h - h0 >= 168 AND (origin_h - h0 - 168) % 12 = 0),
x AS (SELECT o.region, origin_h * 1000 + horizon_h AS o, demand_lag_24h AS a, temperature_2m AS b, demand_mw AS y
  FROM o, (VALUES (1), (6), (24), (72), (168)) t(horizon_h) JOIN merged m ON m.region = o.region AND m.h = origin_h + horizon_h - 1 WHERE demand_lag_24h IS NOT NULL AND temperature_2m IS NOT NULL AND demand_mw IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY o) - 1 AS pos, count(*) OVER (PARTITION BY region) AS n FROM x),
s AS (SELECT *, n // 6 AS size, n - 5 * (n // 6) AS start FROM p)"""


def linear_rows(spark, sf):
    t = direct(spark, sf).select("region", (F.col("origin_h") * 1000 + F.col("horizon_h")).alias("o"), *LINEAR, "target")
    return li.complete(t, LINEAR, "target")


@query("b18_linear_fold_spans", "merged spine", f"""{LINEAR_SQL}
SELECT region, fold, any_value(start) + fold * any_value(size) AS n_train, any_value(start) + fold * any_value(size) AS test_first, any_value(start) + (fold + 1) * any_value(size) - 1 AS test_last,
  min(o) FILTER (pos = start + fold * size) AS first_order FROM s, (SELECT unnest(generate_series(0, 4)) AS fold) WHERE size > 0 GROUP BY region, fold""", i="fold n_train test_first test_last first_order")
def linear_fold_spans(spark, sf):
    """Positions of every fold's test rows, as the blocks dealt to the rows have them."""
    t = li.with_blocks(linear_rows(spark, sf), ["region"], "o", 5)
    sizes = t.groupBy("region", "block").agg(F.count("*").alias("c"), F.min("o").alias("first_order"))
    before = sizes.alias("a").join(sizes.select("region", F.col("block").alias("b"), F.col("c").alias("earlier")), "region").filter("b < block")
    spans = before.groupBy("region", "block", "c", "first_order").agg(F.sum("earlier").alias("n_train"))
    return spans.select("region", (F.col("block") - 1).alias("fold"), "n_train", F.col("n_train").alias("test_first"), (F.col("n_train") + F.col("c") - 1).alias("test_last"), "first_order")


@query("b18_linear_pooled_cv", "merged spine", f"""{LINEAR_SQL},
f AS (SELECT s.*, fold, size = 0 OR pos < start + fold * size AS train FROM s, (SELECT unnest(generate_series(0, 4)) AS fold) WHERE size = 0 OR pos < start + (fold + 1) * size),
c AS (SELECT fold, count(*) AS n_train, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM f WHERE train GROUP BY fold),
w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM c),
g AS (SELECT f.fold, y, my - wa * ma - wb * mb + wa * a + wb * b AS e FROM f JOIN w USING (fold) WHERE NOT train),
r AS (SELECT fold, count(*) AS n_test, avg(abs((y - e) / y)) FILTER (abs(y) > 1e-6) * 100 AS mape, avg(abs(y - e)) AS mae, sqrt(avg((y - e) * (y - e))) AS rmse FROM g GROUP BY fold)
SELECT fold, n_train, my - wa * ma - wb * mb AS intercept, wa AS w_demand_lag_24h, wb AS w_temperature_2m, n_test, mape, mae, rmse FROM w JOIN r USING (fold)""",
       d="intercept w_demand_lag_24h w_temperature_2m mape mae rmse", i="fold")
def linear_pooled_cv(spark, sf):
    return li.cross_validate(linear_rows(spark, sf), LINEAR, "o")


@query("t3_top_feature_importances")
def top_importances(spark, sf):
    model = ln.pooled_forecaster(FEATURES).fit(_training(spark, sf))
    return rk.top_importances(ln.importances(model, FEATURES, spark))


@query("b26_top_drivers_global")
def top_global(spark, sf):
    model = ln.pooled_forecaster(FEATURES).fit(_training(spark, sf))
    return rk.top_importances(ln.importances(model, FEATURES, spark), 3)


@query("x1_forecaster_callback", "weather", "SELECT region, ts, temperature_2m, cloud_cover, 900 + 4 * temperature_2m - 1.5::DOUBLE * cloud_cover AS predicted FROM weather", d="predicted")
def callback(spark, sf):
    w = fr.weather(spark, sf).select("region", "ts", "temperature_2m", "cloud_cover")
    return ln.apply_forecaster(w, lambda p: 900 + 4 * p["temperature_2m"] - 1.5 * p["cloud_cover"])


# -- attribution -----------------------------------------------------------------

def attribution_rows(spark, sf):
    m = windowed(fr.merged(spark, sf), ["region"], "h", {"prev": lambda w: F.lag("demand_mw", 1).over(w)}, before=1)
    x = m.filter("demand_mw IS NOT NULL AND forecast_mw IS NOT NULL")
    return cal.with_holiday_flag(x.select("region", "ts", F.col("demand_mw").alias("actual"), F.col("forecast_mw").alias("predicted"),
                                          F.abs(F.col("demand_mw") - F.col("prev")).alias("ramp"), F.col("temperature_2m").alias("temperature")))


ATT = """x AS (SELECT region, ts, demand_mw AS actual, abs(demand_mw - forecast_mw) AS err, abs(demand_mw - prev) AS ramp, temperature_2m AS t, strftime(ts, '%m-%d') IN ('01-01', '01-15') AS hol
  FROM (SELECT *, lag(demand_mw) OVER (PARTITION BY region ORDER BY h) AS prev FROM merged) WHERE demand_mw IS NOT NULL AND forecast_mw IS NOT NULL),
r AS (SELECT *, CASE WHEN ramp IS NOT NULL THEN row_number() OVER (PARTITION BY region, ramp IS NULL ORDER BY ramp, ts) END AS rr, count(ramp) OVER (PARTITION BY region) AS rn,
  CASE WHEN t IS NOT NULL THEN row_number() OVER (PARTITION BY region, t IS NULL ORDER BY t, ts) END AS tr, count(t) OVER (PARTITION BY region) AS tn, sum(err) OVER (PARTITION BY region) AS total FROM x)"""


def _edges(rank, n, k):
    return "1 + " + " + ".join(f"({rank} > 1 + ({n} - 1) * {i} / {k}.0::DOUBLE)::INT" for i in range(1, k))


@query("a32_error_attribution", "merged", f"""WITH {ATT}
SELECT region, cut, bucket, count(*) AS n, sum(err) AS abs_error, sum(err) / any_value(total) * 100 AS share_pct FROM (SELECT region, err, total, unnest(['hour', 'ramp_quartile', 'temp_quintile', 'weekend', 'holiday']) AS cut,
  unnest([hour(ts)::VARCHAR, ({_edges('rr', 'rn', 4)})::VARCHAR, ({_edges('tr', 'tn', 5)})::VARCHAR, (isodow(ts) >= 6)::VARCHAR, hol::VARCHAR]) AS bucket FROM r) WHERE bucket IS NOT NULL GROUP BY 1, 2, 3""", d="abs_error share_pct")
def error_attribution(spark, sf):
    return bm.error_attribution(attribution_rows(spark, sf))


@query("a32_miss_matrix", "scored", """
WITH p AS (SELECT a.region, a.actual, a.predicted + 200 AS ours, b.predicted + 180 AS official FROM (SELECT * REPLACE (actual + 200 AS actual) FROM scored) a JOIN scored b USING (region, ts) WHERE a.model = 'lag24' AND b.model = 'lag168'),
c AS (SELECT *, abs(actual - ours) AS oe, abs(actual - official) AS fe, CASE WHEN abs(actual - ours) / actual * 100 > 5 AND abs(actual - official) / actual * 100 > 5 THEN 'both' WHEN abs(actual - ours) / actual * 100 > 5 THEN 'ours_only' WHEN abs(actual - official) / actual * 100 > 5 THEN 'theirs_only' ELSE 'neither' END AS cell FROM p)
SELECT region, cell, count(*) AS n, count(*) / any_value(tn) * 100 AS hours_pct, sum(oe) / any_value(te) * 100 AS share_pct, avg(oe) AS our_mean_err, avg(fe) AS official_mean_err FROM (SELECT *, count(*) OVER (PARTITION BY region) AS tn, sum(oe) OVER (PARTITION BY region) AS te FROM c) GROUP BY 1, 2""",
       d="hours_pct share_pct our_mean_err official_mean_err")
def miss_matrix(spark, sf):
    s = fr.scored(spark, sf)
    a = s.filter("model = 'lag24'").select("region", "ts", (F.col("actual") + 200).alias("actual"), (F.col("predicted") + 200).alias("ours"))
    b = s.filter("model = 'lag168'").select("region", "ts", (F.col("predicted") + 180).alias("official"))
    return bm.miss_matrix(a.join(b, ["region", "ts"]))


# -- shadow arm --------------------------------------------------------------------

def shadow_meta(s):
    m = s.groupBy("region", "model").agg(mt.mape().alias("mape"))
    ew = F.when((F.col("region") != "view") | (F.col("model") != "lag48"), F.col("mape") * F.when(F.col("model") == "lag24", 0.7).otherwise(1.0))
    return en.weighting_input(m.withColumn("mape_ewma", ew), smoothed_on=False)


SHADOW = """m AS (SELECT region, model, mape, mape * CASE WHEN model = 'lag24' THEN 0.7::DOUBLE ELSE 1 END AS ew, bool_and(region <> 'view') OVER (PARTITION BY region) AS ok FROM (SELECT region, model, avg(abs((actual - predicted) / actual)) * 100 AS mape FROM scored GROUP BY ALL)),
led AS (SELECT s.region, ts, any_value(actual) AS actual, any_value(lead_hours) AS lead_hours, sum(pow(1 / mape, 3) * predicted) / sum(pow(1 / mape, 3)) AS served, sum(pow(1 / ew, 3) * predicted) / sum(pow(1 / ew, 3)) AS shadow FROM scored s JOIN m USING (region, model) WHERE ok GROUP BY 1, 2)"""


def shadow_ledger(spark, sf):
    s = stored(fr.scored(spark, sf).select("region", "model", "ts", "actual", "predicted", "lead_hours"), "scored")
    led = sh.ledger(s, shadow_meta(s))
    hours_ = s.groupBy("region", "ts").agg(F.max("actual").alias("actual"), F.max("lead_hours").alias("lead_hours"))
    return led.join(hours_, ["region", "ts"])


@query("b27_shadow_ledger", "scored", f"WITH {SHADOW} SELECT * FROM led", d="actual served shadow")
def ledger(spark, sf):
    return shadow_ledger(spark, sf)


@query("b27_shadow_evaluation", "scored", f"""WITH {SHADOW},
l1 AS (SELECT region, ts, actual + 3000 AS actual, served + 3000 AS served, shadow + 3000 AS shadow FROM led WHERE lead_hours IS NULL OR lead_hours <= 24),
k AS (SELECT l1.* FROM l1 JOIN (SELECT region, quantile_cont(actual, 0.5) AS md FROM l1 GROUP BY region) USING (region) WHERE actual >= 0.1 * md),
a AS (SELECT region, ts, actual, unnest(['served', 'shadow']) AS arm, unnest([served, shadow]) AS p FROM k),
per AS (SELECT region, arm, avg((p - actual) / actual) * 100 AS bias_pct, avg(abs(p - actual) / actual) * 100 AS mape, sum(abs(p - actual)) / sum(actual) * 100 AS wape FROM a GROUP BY ALL),
po AS (SELECT arm, avg((p - actual) / actual) * 100 AS bias_pct, avg(abs(p - actual) / actual) * 100 AS mape, sum(abs(p - actual)) / sum(actual) * 100 AS wape FROM a GROUP BY ALL),
ma AS (SELECT {', '.join(f"avg({x}) FILTER (arm = '{r}') AS macro_{r}_{x}" for r in sh.ARMS for x in ('bias_pct', 'mape', 'wape'))} FROM per),
pw AS (SELECT {', '.join(f"avg({x}) FILTER (arm = '{r}') AS pooled_{r}_{x}" for r in sh.ARMS for x in ('bias_pct', 'mape', 'wape'))} FROM po),
wi AS (SELECT count(*) AS n_regions, count(*) FILTER (sh < se) AS shadow_wins FROM (SELECT region, max(mape) FILTER (arm = 'served') AS se, max(mape) FILTER (arm = 'shadow') AS sh FROM per GROUP BY region)),
sp AS (SELECT quantile_cont(d, 0.5) AS span_days FROM (SELECT epoch(max(ts) - min(ts)) / 86400 AS d FROM k GROUP BY region))
SELECT *, CASE WHEN abs(macro_served_bias_pct) > 2 OR abs(pooled_served_bias_pct) > 2 THEN 'control_fails_constraint' WHEN span_days < 14 THEN 'too_short' WHEN abs(macro_shadow_bias_pct) > 2 OR macro_shadow_mape - macro_served_mape > 0.5 THEN 'fails' ELSE 'passes' END AS verdict FROM ma, pw, wi, sp""",
       d=" ".join(f"{t}_{r}_{x}" for t in ("macro", "pooled") for r in sh.ARMS for x in ("bias_pct", "mape", "wape")) + " span_days")
def shadow_evaluation(spark, sf):
    x = stored(shadow_ledger(spark, sf), "shadow").select("region", "ts", "lead_hours", *[(F.col(c) + 3000).alias(c) for c in ("actual", "served", "shadow")])
    return sh.evaluate(sh.filtered(x, max_lead=24))


# -- downsampling ---------------------------------------------------------------------

def series(spark, sf):
    return fr.hourly(spark, sf).select("region", hour_number("ts").alias("x"), F.col("demand_mw").alias("y"))


LTTB = """WITH RECURSIVE s AS (SELECT region, CAST(epoch(ts) / 3600 AS DOUBLE) AS x, demand_mw AS y, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY region) AS n FROM hourly),
bk AS (SELECT region, b, CAST(floor(b * (n - 2) / 98.0::DOUBLE) AS BIGINT) + 1 AS lo, least(CAST(floor((b + 1) * (n - 2) / 98.0::DOUBLE) AS BIGINT) + 1, n - 1) AS hi, least(CAST(floor((b + 2) * (n - 2) / 98.0::DOUBLE) AS BIGINT) + 1, n) AS hi2, n FROM (SELECT DISTINCT region, n FROM s), (SELECT unnest(generate_series(0, 97)) AS b)),
av AS (SELECT bk.region, b, lo, hi, avg(x) AS ax, avg(y) AS ay FROM bk JOIN s ON s.region = bk.region AND i >= hi AND i < greatest(hi2, hi + 1) GROUP BY ALL),
w AS (SELECT region, -1 AS b, x, y FROM s WHERE i = 0 UNION ALL
  SELECT region, b, x, y FROM (SELECT w.region, av.b, s.x, s.y, row_number() OVER (PARTITION BY w.region ORDER BY abs((w.x - ax) * (s.y - w.y) - (w.x - s.x) * (ay - w.y)) DESC, s.i) AS rn FROM w JOIN av ON av.region = w.region AND av.b = w.b + 1 JOIN s ON s.region = w.region AND s.i >= lo AND s.i < hi) WHERE rn = 1)
SELECT region, x, y FROM w UNION ALL SELECT region, x, y FROM s WHERE i = n - 1"""


@query("g6_lttb_downsample", "hourly", LTTB)
def lttb(spark, sf):
    return ds.lttb(series(spark, sf), ["region"], "x", "y", 100)


@query("x2_bucket_extremes", "hourly", """
SELECT region, bucket, arg_min(y, i) AS first, arg_max(y, i) AS last, min(y) AS low, max(y) AS high, CAST((list(x ORDER BY y, i))[1] AS BIGINT) AS low_at, CAST((list(x ORDER BY y DESC, i))[1] AS BIGINT) AS high_at FROM (
SELECT region, CAST(epoch(ts) / 3600 AS BIGINT) AS x, demand_mw AS y, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS i, ((row_number() OVER (PARTITION BY region ORDER BY ts) - 1) * 60) // count(*) OVER (PARTITION BY region) AS bucket FROM hourly) GROUP BY 1, 2""")
def extremes(spark, sf):
    return ds.m4(series(spark, sf), ["region"], "x", "y", 60)
