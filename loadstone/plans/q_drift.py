"""Drift queries over the graded seasonal arms."""

from pyspark.sql import functions as F

from loadstone.operators import drift as dr
from loadstone.operators import metrics as mt
from loadstone.operators.series import hour_number, hour_spine, hours, newest
from loadstone.plans import frames as fr
from loadstone.plans.registry import query

NOW = "2024-01-30 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def forecasts(spark, sf):
    """One served forecast per region and origin every six hours, 80 hours ahead.

    ``preds`` maps the three seasonal arms to their value at the target hour.
    """
    s = fr.scored(spark, sf).select("region", F.col("ts").alias("target_ts"), "model", "predicted")
    preds = s.groupBy("region", "target_ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "predicted")))).alias("preds"))
    six = F.floor(hour_number("target_ts") / 6) * 6
    back = F.explode(F.sequence(F.lit(0), F.lit(78), F.lit(6)))
    return preds.select("*", back.alias("_b")).select(
        "region", "target_ts", "preds", F.timestamp_seconds((six - F.col("_b")) * 3600).alias("origin")).withColumn("made_at", F.col("origin") - hours(1))


FORECASTS = """forecasts AS (SELECT region, target_ts, models, preds, to_timestamp((six - b) * 3600)::TIMESTAMP AS origin, to_timestamp((six - b - 1) * 3600)::TIMESTAMP AS made_at
  FROM (SELECT region, ts AS target_ts, list(model ORDER BY model) AS models, list(predicted ORDER BY model) AS preds, (CAST(epoch(ts) / 3600 AS BIGINT) // 6) * 6 AS six FROM scored GROUP BY region, ts),
  LATERAL (SELECT unnest(generate_series(0, 78, 6)) AS b))"""


def actuals(spark, sf):
    return fr.hourly(spark, sf).select("region", F.col("ts").alias("target_ts"), F.col("demand_mw").alias("actual"))


@query("j4_newest_match", "scored hourly", f"""WITH {FORECASTS},
f AS (SELECT * FROM forecasts WHERE origin = TIMESTAMP '2024-01-27 12:00:00'),
m AS (SELECT f.*, demand_mw AS actual FROM f JOIN hourly h ON f.region = h.region AND f.target_ts = h.ts WHERE h.ts < TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY f.region ORDER BY target_ts DESC) = 1)
SELECT region, model, target_ts, predicted, actual, abs(actual - predicted) / actual * 100 AS abs_pct_error, 200 * abs(actual - predicted) / (actual + predicted) AS smape,
  CAST(epoch(target_ts - origin) / 3600 + 1 AS BIGINT) AS lead_hours FROM (SELECT region, target_ts, origin, actual, unnest(models) AS model, unnest(preds) AS predicted FROM m)""",
       d="predicted actual abs_pct_error smape")
def newest_match(spark, sf):
    f = forecasts(spark, sf).filter(F.col("origin") == F.lit("2024-01-27 12:00:00").cast("timestamp"))
    return dr.newest_match(f, actuals(spark, sf).filter(F.col("target_ts") < now()))


def pending(spark, sf):
    return dr.dedup_snapshots(dr.horizon_snapshots(forecasts(spark, sf)))


SNAPS = FORECASTS + """, snaps AS (SELECT region, target_ts, CAST(epoch(target_ts - origin) / 3600 AS BIGINT) || 'h' AS horizon, models, preds, made_at FROM forecasts
  WHERE epoch(target_ts - origin) / 3600 IN (24, 48, 72))"""


@query("d4_horizon_snapshots", "scored", f"WITH {SNAPS} SELECT region, target_ts, horizon, made_at, len(models) AS n_models, preds[1] AS first_pred FROM snaps", d="first_pred", i="n_models")
def horizon_snapshots(spark, sf):
    x = dr.horizon_snapshots(forecasts(spark, sf))
    first = F.map_values("preds")[0]
    return x.select("region", "target_ts", "horizon", "made_at", F.size("preds").alias("n_models"), first.alias("first_pred"))


@query("d3_snapshot_dedup", "scored", f"WITH {SNAPS} SELECT region, horizon, count(DISTINCT target_ts) AS kept, count(*) - count(DISTINCT target_ts) AS skipped FROM snaps GROUP BY 1, 2")
def snapshot_dedup(spark, sf):
    s = dr.horizon_snapshots(forecasts(spark, sf))
    return dr.dedup_snapshots(s).groupBy("region", "horizon").agg(F.count("*").alias("kept"), F.sum("skipped").alias("skipped"))


@query("j5_resolve_pending", "scored hourly", f"""WITH {SNAPS}
SELECT region, target_ts, horizon, actual, model, predicted, abs(actual - predicted) / actual * 100 AS abs_pct_error FROM
  (SELECT s.region, target_ts, horizon, demand_mw AS actual, unnest(models) AS model, unnest(preds) AS predicted FROM snaps s JOIN hourly h ON s.region = h.region AND s.target_ts = h.ts
   WHERE hour(h.ts) % 12 <> 0 AND demand_mw > 0)""", d="actual predicted abs_pct_error")
def resolve_pending(spark, sf):
    return dr.resolve_pending(pending(spark, sf), actuals(spark, sf).filter(F.hour("target_ts") % 12 != 0))[0]


@query("j5_still_pending", "scored hourly", f"""WITH {SNAPS}
SELECT region, horizon, count(*) AS n FROM snaps s ANTI JOIN (SELECT region, ts AS target_ts FROM hourly WHERE hour(ts) % 12 <> 0 AND demand_mw > 0) h USING (region, target_ts) GROUP BY 1, 2""")
def still_pending(spark, sf):
    return dr.resolve_pending(pending(spark, sf), actuals(spark, sf).filter(F.hour("target_ts") % 12 != 0))[1].groupBy("region", "horizon").agg(F.count("*").alias("n"))


@query("d2_expired_pending", "scored", f"""WITH {SNAPS}
SELECT horizon, count(*) FILTER (t >= TIMESTAMP '{NOW}' - INTERVAL 120 HOUR) AS kept, count(*) FILTER (t < TIMESTAMP '{NOW}' - INTERVAL 120 HOUR) AS expired, count(*) FILTER (t IS NULL) AS malformed
FROM (SELECT horizon, CASE WHEN hour(target_ts) <> 5 THEN target_ts END AS t FROM snaps) GROUP BY horizon""")
def expired(spark, sf):
    p = pending(spark, sf).withColumn("target_ts", F.when(F.hour("target_ts") != 5, F.col("target_ts")))
    return dr.expire(p, now())


def revised(spark, sf):
    """Later actuals: every fifth hour moved, every seventh non-positive."""
    h = F.hour("ts")
    return fr.hourly(spark, sf).select("region", "ts", F.when(h % 7 == 0, 0.0).when(h % 5 == 0, F.col("demand_mw") * 1.08).otherwise(F.col("demand_mw")).alias("actual"))


REVISED = "revised AS (SELECT region, ts, CASE WHEN hour(ts) % 7 = 0 THEN 0.0 WHEN hour(ts) % 5 = 0 THEN demand_mw * 1.08::DOUBLE ELSE demand_mw END AS now_mw FROM hourly)"


@query("j7_regrade", "scored hourly", f"""WITH {REVISED}
SELECT region, model, ts, predicted, actual, moved AS regraded, shift_pct, abs(actual - predicted) / actual * 100 AS abs_pct_error, 200 * abs(actual - predicted) / (actual + predicted) AS smape FROM (
SELECT region, model, ts, predicted, moved, CASE WHEN moved THEN now_mw ELSE actual END AS actual, CASE WHEN moved THEN abs(now_mw - actual) / now_mw * 100 END AS shift_pct
FROM (SELECT *, now_mw > 0 AND round(now_mw, 2) <> round(actual, 2) AS moved FROM scored JOIN revised USING (region, ts)))""", d="predicted actual shift_pct abs_pct_error smape")
def regrade(spark, sf):
    return dr.regrade(fr.scored(spark, sf).drop("lead_hours", "placeholder"), revised(spark, sf))


@query("j7_regrade_stats", "scored hourly", f"""WITH {REVISED}
SELECT region, model, count(*) FILTER (moved) AS n_regraded, avg(abs(now_mw - actual) / now_mw * 100) FILTER (moved) AS mean_abs_shift_pct, max(abs(now_mw - actual) / now_mw * 100) FILTER (moved) AS max_abs_shift_pct
FROM (SELECT *, now_mw > 0 AND round(now_mw, 2) <> round(actual, 2) AS moved FROM scored JOIN revised USING (region, ts)) GROUP BY 1, 2""", d="mean_abs_shift_pct max_abs_shift_pct")
def regrade_stats(spark, sf):
    return dr.regrade_stats(dr.regrade(fr.scored(spark, sf), revised(spark, sf)), ["region", "model"])


def _spans(lead):
    return f"""w AS (SELECT * FROM scored, (VALUES ('7d', 168), ('30d', 720)) s(span, hrs)
  WHERE ts >= TIMESTAMP '{NOW}' - to_hours(hrs)),
med AS (SELECT region, model, span, quantile_cont(actual, 0.5) AS m FROM w WHERE lead_hours IS NULL OR lead_hours <= {lead} GROUP BY ALL),
f AS (SELECT w.*, (lead_hours IS NULL OR lead_hours <= {lead}) AS lk, (lead_hours IS NULL OR lead_hours <= {lead}) AND actual >= 0.1 * m AS ok FROM w LEFT JOIN med USING (region, model, span)),
blk AS (SELECT region, model, span, avg(abs(actual - predicted) / actual * 100) FILTER (ok) AS mape, avg(200 * abs(actual - predicted) / (actual + predicted)) FILTER (ok) AS smape, count(*) FILTER (ok) AS n,
  count(*) FILTER (lk AND NOT ok) AS low, count(*) FILTER (NOT lk) AS far, count(*) FILTER (lead_hours IS NULL) AS unk, count(*) FILTER (ok AND placeholder) AS ph, count(*) FILTER (ok AND placeholder IS NULL) AS phu FROM f GROUP BY ALL)"""


BLOCK_D = "rolling_smape_7d rolling_smape_30d rolling_mape_7d rolling_mape_30d"


@query("w14_rolling_drift", "scored", f"""WITH {_spans(6)}
SELECT a.region, a.model, r.n_records, a.smape AS rolling_smape_7d, b.smape AS rolling_smape_30d, a.mape AS rolling_mape_7d, b.mape AS rolling_mape_30d, a.n AS n_7d, b.n AS n_30d,
  a.low AS n_low_actual_excluded_7d, a.far AS n_lead_excluded_7d, a.unk AS n_lead_unknown_7d, a.ph AS n_anchor_placeholder_7d, a.phu AS n_anchor_unknown_7d
FROM blk a JOIN blk b USING (region, model) JOIN (SELECT region, model, count(*) AS n_records FROM scored GROUP BY ALL) r USING (region, model) WHERE a.span = '7d' AND b.span = '30d'""", d=BLOCK_D)
def rolling_drift(spark, sf):
    return dr.rolling_block(fr.scored(spark, sf), now(), max_lead=6)


@query("w14_running_error", "scored", """
SELECT region, model, ts, avg(abs(actual - predicted) / actual * 100) OVER w AS running_mape, count(*) OVER w AS running_n FROM scored
WINDOW w AS (PARTITION BY region, model ORDER BY ts RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND CURRENT ROW)""", d="running_mape")
def running_error(spark, sf):
    return dr.running_error(fr.scored(spark, sf)).select("region", "model", "ts", "running_mape", "running_n")


@query("a45_anchor_provenance_counts", "scored", """
SELECT region, model, count(*) FILTER (placeholder) AS n_placeholder, count(*) FILTER (placeholder IS NULL) AS n_unknown FROM scored GROUP BY ALL""")
def provenance_counts(spark, sf):
    return fr.scored(spark, sf).groupBy("region", "model").agg(F.count_if("placeholder").alias("n_placeholder"), F.count_if(F.col("placeholder").isNull()).alias("n_unknown"))


@query("j8_settled_reconciliation", "scored hourly", f"""WITH {REVISED},
d AS (SELECT region, model, avg(abs(actual - predicted) / actual * 100) AS displayed_mape FROM scored GROUP BY ALL),
j AS (SELECT s.*, now_mw AS settled FROM scored s JOIN revised USING (region, ts) WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 168 HOUR AND (lead_hours IS NULL OR lead_hours <= 12) AND now_mw > 0),
m AS (SELECT region, model, quantile_cont(settled, 0.5) AS med, avg(abs(settled - actual) / settled * 100) AS mean_abs_revision_pct FROM j GROUP BY ALL),
k AS (SELECT region, model, avg(abs(settled - predicted) / settled * 100) AS settled_mape, count(*) AS n_compared FROM j JOIN m USING (region, model) WHERE settled >= 0.1 * med GROUP BY ALL)
SELECT region, model, displayed_mape, settled_mape, n_compared, mean_abs_revision_pct, CASE WHEN n_compared >= 24 THEN abs(displayed_mape - settled_mape) END AS divergence_pct_points,
  concat_ws(',', CASE WHEN n_compared >= 24 AND abs(displayed_mape - settled_mape) > 2 THEN CASE WHEN displayed_mape > settled_mape THEN 'displayed_overstates' ELSE 'displayed_understates' END END,
    CASE WHEN n_compared >= 24 AND mean_abs_revision_pct > 1 THEN 'high_eia_revision' END) AS reasons,
  CASE WHEN n_compared < 24 THEN 'insufficient_settled_overlap' END AS skipped, reasons = '' AS ok FROM d LEFT JOIN k USING (region, model) LEFT JOIN m USING (region, model)""",
       d="displayed_mape settled_mape mean_abs_revision_pct divergence_pct_points")
def reconciliation(spark, sf):
    s = fr.scored(spark, sf)
    shown = s.groupBy("region", "model").agg(F.avg(mt.ape()).alias("displayed_mape"))
    out = dr.reconcile(s, revised(spark, sf).withColumnRenamed("actual", "settled"), shown, now(), max_lead=12, max_revision=1.0)
    return out.withColumn("reasons", F.array_join("reasons", ","))


CHAMP = """champ AS (SELECT region, window_no, arg_min(model, wape) AS champion, min(wape) AS wape FROM (
  SELECT region, CAST(floor(epoch(mx - ts) / (3600 * 168)) AS BIGINT) AS window_no, model, sum(abs(actual - predicted)) / sum(actual) * 100 AS wape, count(*) AS n
  FROM scored JOIN (SELECT region, max(ts) AS mx FROM scored GROUP BY region) USING (region) GROUP BY ALL HAVING count(*) >= 24) GROUP BY ALL HAVING count(*) = 3)"""


@query("w24_window_champions", "scored", f"WITH {CHAMP} SELECT * FROM champ", d="wape")
def window_champions(spark, sf):
    return dr.champions(fr.scored(spark, sf), ["region"])


@query("w24_champion_flips", "scored", f"WITH {CHAMP} SELECT region, count(*) AS n_windows, CASE WHEN count(*) >= 2 THEN count(DISTINCT champion) > 1 END AS flipped FROM champ GROUP BY region")
def champion_flips(spark, sf):
    return dr.champion_flips(dr.champions(fr.scored(spark, sf), ["region"]), ["region"])


@query("w25_visibility_hysteresis", "scored", """
WITH best AS (SELECT region, CAST(ts AS DATE) AS day, CAST(epoch(date_trunc('day', ts)) / 86400 AS BIGINT) AS k, min(m) AS mape FROM (SELECT region, date_trunc('day', ts) AS ts, model, avg(abs(actual - predicted) / (actual + 400)) * 60 AS m FROM scored GROUP BY ALL) GROUP BY ALL)
SELECT region, k, mape, coalesce(last_value(CASE WHEN mape > 22 THEN false WHEN mape <= 19 THEN true END IGNORE NULLS) OVER (PARTITION BY region ORDER BY k ROWS UNBOUNDED PRECEDING), true) AS visible FROM best""", d="mape")
def visibility(spark, sf):
    day = F.floor(F.unix_timestamp(F.date_trunc("day", "ts")) / 86400).alias("k")
    err = F.abs(F.col("actual") - F.col("predicted")) / (F.col("actual") + 400)
    best = fr.scored(spark, sf).groupBy("region", day, "model").agg((F.avg(err) * 60).alias("m")).groupBy("region", "k").agg(F.min("m").alias("mape"))
    return dr.visibility(best, ["region"], "k", "mape")


GRADE24 = "CASE WHEN {0} <= 2 THEN 'excellent' WHEN {0} <= 3.5 THEN 'target' WHEN {0} <= 7 THEN 'acceptable' ELSE 'rollback' END"


@query("b16_live_champion_and_gate", "scored", f"""
SELECT region, champion, champion_mape, n_models, {GRADE24.format('champion_mape')} AS grade, holdout <= 22 AND {GRADE24.format('champion_mape')} = 'rollback' AS gate_disagrees
FROM (SELECT region, arg_min(model, m) AS champion, min(m) AS champion_mape, count(*) AS n_models, min(h) AS holdout FROM (
  SELECT region, model, avg(abs(actual - predicted) / (actual + 1000)) * 100 AS m, avg(abs(actual - predicted) / (actual + 500)) * 100 AS h FROM scored GROUP BY ALL) GROUP BY region)""", d="champion_mape")
def live_champion(spark, sf):
    err = F.abs(F.col("actual") - F.col("predicted"))
    per = fr.scored(spark, sf).groupBy("region", "model").agg(
        (F.avg(err / (F.col("actual") + 1000)) * 100).alias("rolling_mape"), (F.avg(err / (F.col("actual") + 500)) * 100).alias("holdout"))
    gate = per.groupBy("region").agg((F.min("holdout") <= dr.MAPE_BANDS["7d"][3]).alias("acceptable"))
    return dr.live_verdict(per).join(gate, "region").withColumn("gate_disagrees", F.col("acceptable") & (F.col("grade") == "rollback")).drop("acceptable")


@query("f13_mape_grade", "scored", f"""SELECT region, model, ts, {GRADE24.format('e')} AS grade_24h,
  CASE WHEN e <= 6 THEN 'excellent' WHEN e <= 9 THEN 'target' WHEN e <= 15 THEN 'acceptable' ELSE 'rollback' END AS grade_7d FROM (SELECT *, abs(actual - predicted) / actual * 10 AS e FROM scored)""")
def mape_grade(spark, sf):
    e = mt.ape() / 10
    return fr.scored(spark, sf).select("region", "model", "ts", dr.grade(e, "24h").alias("grade_24h"), dr.grade(e, F.lit("7d")).alias("grade_7d"))


@query("a46_diagnostics_totals", "scored", f"""WITH {SNAPS}
SELECT horizon, sum(skipped) AS n_dedup_skipped, sum(expired) AS n_expired FROM (SELECT horizon, date_trunc('hour', target_ts) AS logged_at, count(*) AS skipped, count(*) FILTER (hour(target_ts) = 5) AS expired FROM snaps GROUP BY ALL)
WHERE logged_at >= TIMESTAMP '{NOW}' - INTERVAL 168 HOUR GROUP BY horizon""", i="n_dedup_skipped n_expired")
def diagnostics(spark, sf):
    log = dr.horizon_snapshots(forecasts(spark, sf)).groupBy("horizon", F.col("target_ts").alias("logged_at")).agg(
        F.count("*").alias("n_dedup_skipped"), F.count_if(F.hour("target_ts") == 5).alias("n_expired"))
    return dr.diagnostics_totals(log, now(), ["n_dedup_skipped", "n_expired"])


ORIGINS = "origins AS (SELECT region, ts, CAST(epoch(ts) / 3600 AS BIGINT) AS h, to_timestamp((CAST(epoch(ts) / 3600 AS BIGINT) - CAST(epoch(ts) / 3600 AS BIGINT) % 3) * 3600)::TIMESTAMP AS origin FROM hourly)"


@query("a47_coverage_channels", "scored hourly", f"""WITH {ORIGINS},
win AS (SELECT region, unnest(generate_series(TIMESTAMP '{NOW}' - INTERVAL 168 HOUR, TIMESTAMP '{NOW}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT region FROM hourly)),
c AS (SELECT win.region, CASE WHEN s.region IS NOT NULL THEN 'resolved' WHEN p.region IS NOT NULL THEN 'pending' WHEN o.origin IS NULL OR q.origin IS NULL THEN 'unknown' WHEN o.origin = q.origin THEN 'skip' ELSE 'freeze' END AS ch
  FROM win LEFT JOIN (SELECT DISTINCT region, ts FROM scored WHERE hour(ts) % 4 <> 0 AND model = 'lag24') s USING (region, ts)
  LEFT JOIN (SELECT DISTINCT region, ts FROM scored WHERE hour(ts) = 8) p USING (region, ts)
  LEFT JOIN origins o ON o.region = win.region AND o.ts = win.ts - INTERVAL 24 HOUR LEFT JOIN origins q ON q.region = win.region AND q.ts = win.ts - INTERVAL 25 HOUR)
SELECT coalesce(region, 'FLEET') AS region, count(*) FILTER (ch = 'resolved') AS resolved, count(*) FILTER (ch = 'skip') AS skip, count(*) FILTER (ch = 'freeze') AS freeze,
  count(*) FILTER (ch = 'pending') AS pending, count(*) FILTER (ch = 'unknown') AS unknown FROM c GROUP BY ROLLUP (region)""")
def coverage_channels(spark, sf):
    h = fr.hourly(spark, sf)
    n = hour_number("ts")
    origins = h.select("region", "ts", F.timestamp_seconds((n - n % 3) * 3600).alias("origin"))
    window = h.select("region").distinct().select("region", F.explode(F.sequence(now() - hours(168), now() - hours(1), F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    s = fr.scored(spark, sf)
    return dr.coverage_channels(window, s.filter("hour(ts) % 4 <> 0 AND model = 'lag24'"), s.filter("hour(ts) = 8"), origins)


@query("d8_monotone_origin", "hourly", """
SELECT region, ts, origin FROM (SELECT *, max(origin) OVER (PARTITION BY region ORDER BY ts) AS best FROM (SELECT region, ts, ts - to_hours(CASE WHEN hour(ts) % 5 = 0 THEN 4 ELSE 0 END) AS origin FROM hourly)) WHERE origin >= best""")
def monotone_origin(spark, sf):
    f = fr.hourly(spark, sf).withColumn("made_no", hour_number("ts")).withColumn(
        "origin", F.col("ts") - F.when(F.hour("ts") % 5 == 0, F.expr("INTERVAL 4 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS")))
    return dr.monotone_origins(f).select("region", "ts", "origin")


@query("t6_fifo_trim", "scored", "SELECT region, model, ts, predicted FROM scored QUALIFY row_number() OVER (PARTITION BY region, model ORDER BY ts DESC) <= 100")
def fifo_trim(spark, sf):
    return newest(fr.scored(spark, sf), ["region", "model"], "ts", 100).select("region", "model", "ts", "predicted")


@query("t12_coverage_rows", "scored", "SELECT region, count(*) AS n, epoch(max(ts) - min(ts)) / 86400 AS days FROM scored GROUP BY region ORDER BY n", d="days")
def coverage_rows(spark, sf):
    return fr.scored(spark, sf).groupBy("region").agg(
        F.count("*").alias("n"), ((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400).alias("days")).orderBy("n", "region")


@query("u7_upsert_new_wins", "scored", f"""
SELECT region, model, ts, CASE WHEN ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR THEN predicted + 1 ELSE predicted END AS predicted FROM scored""", d="predicted")
def upsert(spark, sf):
    from loadstone.operators.series import keep_one

    s = fr.scored(spark, sf).select("region", "model", "ts", "predicted")
    stored = s.withColumn("prio", F.lit(1))
    new = s.filter(F.col("ts") >= now() - hours(48)).withColumn("predicted", F.col("predicted") + 1).withColumn("prio", F.lit(0))
    return keep_one(stored.unionByName(new), ["region", "model", "ts"], F.col("prio")).drop("prio")


@query("u5_model_name_union", "scored", "SELECT DISTINCT region, model FROM (SELECT region, model FROM scored WHERE model <> 'lag168' UNION SELECT region, model FROM scored WHERE model <> 'lag24')")
def model_names(spark, sf):
    s = fr.scored(spark, sf).select("region", "model")
    return s.filter("model <> 'lag168'").union(s.filter("model <> 'lag24'")).distinct()


@query("g11_lead_hours", "scored", f"WITH {FORECASTS} SELECT region, target_ts, origin, CASE WHEN l >= 1 THEN l END AS lead_hours FROM (SELECT *, CAST(floor(epoch(target_ts - origin) / 3600) AS BIGINT) - 2 AS l FROM forecasts)")
def lead_from_first(spark, sf):
    lead = ((F.unix_timestamp("target_ts") - F.unix_timestamp(F.col("origin") + hours(3))) / 3600).cast("long") + 1
    return forecasts(spark, sf).select("region", "target_ts", "origin", F.when(lead >= 1, lead).alias("lead_hours"))


@query("g12_observed_lead", "scored", f"WITH {FORECASTS} SELECT DISTINCT region, origin, epoch(origin + INTERVAL 24 HOUR - made_at) / 3600 AS observed_24h, epoch(origin + INTERVAL 48 HOUR - made_at) / 3600 AS observed_48h FROM forecasts",
       d="observed_24h observed_48h")
def observed_lead(spark, sf):
    from loadstone.operators.series import lead_hours

    f = forecasts(spark, sf).select("region", "origin", "made_at").distinct()
    return f.select("region", "origin", *[lead_hours(F.col("origin") + hours(n), "made_at").alias(f"observed_{n}h") for n in (24, 48)])


@query("g1_hour_spine", "spine", "SELECT region, ts, demand_mw FROM spine")
def spine(spark, sf):
    return hour_spine(fr.hourly(spark, sf), ["region"])
