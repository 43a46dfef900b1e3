"""Streaming queries: tables are staged, streamed to the end, and compared with
their batch result."""

from pyspark.sql import functions as F

from loadstone.functions import text as tx
from loadstone.operators.backtest import recompute_cadence
from loadstone.operators.series import lead_hours
from loadstone.plans import frames as fr
from loadstone.plans.q_drift import BLOCK_D, NOW, REVISED, SNAPS, _spans, forecasts, now, revised
from loadstone.plans.q_grid import SNAP, snapshots
from loadstone.plans.q_sources import METADATA_SQL, broken, metadata
from loadstone.plans.registry import query
from loadstone.session import scratch_path
from loadstone.sources import files
from loadstone.streaming import late, ledger
from loadstone.streaming import operators as so
from loadstone.streaming.sinks import dead_letters, drain, read_latest, staged, stream_table, update_log
from loadstone.streaming.vintage import read_vintages, vintage_stream

WEEK = 7 * 86400


def streamed(df, name, files=None):
    """Stage a batch table and open it as a file stream."""
    return stream_table(df.sparkSession, staged(df, name), df.schema, files)


def ticks(df, on, n=3):
    """``df`` cut into ``n`` tables by a hash, so that all but the first bring late rows."""
    part = F.pmod(F.xxhash64(*on), F.lit(n))
    return [df.filter(part == k) for k in range(n)]


def in_ticks(parts, name, run):
    """Append tables to a folder one after another and run the stream over it after each; the last result."""
    spark = parts[0].sparkSession
    base, path = scratch_path(spark, f"{name}-rows"), scratch_path(spark, name)
    for part in parts:
        part.write.mode("append").parquet(base)
        out = run(stream_table(spark, base, part.schema), path)
    return out


def event_stream(spark, sf):
    e = fr.events(spark, sf).select(F.col("event_type").alias("region"), "ts", F.col("value").alias("demand_mw"))
    return streamed(e, "events")


@query("d7_stream_hourly_totals", "hourly", "SELECT region, ts, demand_mw FROM hourly", d="demand_mw")
def hourly_totals(spark, sf):
    return drain(so.hourly_totals(event_stream(spark, sf), ["region"], "ts", "demand_mw"), "hourly", ["region", "ts"]).select("region", "ts", "demand_mw")


@query("d13_stream_activity_runs", "", """
SELECT region, min(h) AS start, max(h) AS "end", CAST(sum(c) AS BIGINT) AS n FROM (SELECT region, h, c, epoch(h) / 3600 - row_number() OVER (PARTITION BY region ORDER BY h) AS k FROM (SELECT event_type AS region, date_trunc('hour', ts) AS h, count(*) AS c FROM events GROUP BY 1, 2)) GROUP BY region, k
HAVING max(h) + INTERVAL 3601 SECOND <= (SELECT max(date_trunc('hour', ts)) FROM events) - INTERVAL 2 HOUR""")
def activity_runs(spark, sf):
    """Runs closed by the watermark; a run still open at the end stays in state."""
    return drain(so.activity_runs(event_stream(spark, sf), ["region"], "ts"), "runs", mode="append")


@query("d1_stream_vintage", "vintage", "SELECT * FROM vintage", d="first_seen_d first_seen_df last_d")
def stream_vintage(spark, sf):
    """Three ticks: readings are appended in capture order, the stream runs after each."""
    r = fr.readings(spark, sf)
    path, base, state = (scratch_path(spark, n) for n in ("vintage", "readings", "vintage-state"))
    lag = lead_hours("captured_at", "target_ts")
    for low, high in ((0, 2), (2, 4), (4, 99)):
        r.filter((lag > low) & (lag <= high)).write.mode("append").parquet(base)
        vintage_stream(stream_table(spark, base, r.schema), path, state, 60).awaitTermination()
    return read_vintages(spark, path).drop("period", "version")


@query("d3_stream_first_snapshots", "scored", f"""WITH {SNAPS}
SELECT horizon, count(*) AS kept, count(*) FILTER (hour(target_ts) % 3 = 0) AS skipped, count(*) AS first_made FROM snaps GROUP BY 1""")
def stream_dedup(spark, sf):
    """Every third hour is forecast again two hours later, and that one comes first; the first made is kept, the other counted."""
    f = forecasts(spark, sf).select("region", "target_ts", "origin", "made_at")
    again = f.filter(F.hour("target_ts") % 3 == 0).withColumn("made_at", F.col("made_at") + F.expr("INTERVAL 2 HOURS"))
    half = F.col("target_ts") < F.lit("2024-01-16").cast("timestamp")
    base, out, state = (scratch_path(spark, n) for n in ("forecasts", "snapshots", "snapshots-state"))
    for part in (again.filter(half), f.filter(half), again.filter(~half), f.filter(~half)):
        part.write.mode("append").parquet(base)
        stream = so.first_snapshots(so.snapshots(stream_table(spark, base, f.schema)), 31 * 24)  # all ticks lie within the lateness bound
        update_log(stream, out, state).awaitTermination()
    kept = read_latest(spark, out, stream.schema, ["region", "target_ts", "horizon"])
    lead = F.unix_timestamp("target_ts") - F.unix_timestamp("made_at") - 3600
    return kept.groupBy("horizon").agg(F.count("*").alias("kept"), F.sum("skipped").alias("skipped"), F.count_if(F.concat((lead / 3600).cast("int").cast("string"), F.lit("h")) == F.col("horizon")).alias("first_made"))


@query("d2_stream_resolution", "scored hourly", """
SELECT region, model, count(*) AS resolved, avg(abs(actual - predicted) / actual * 100) AS mape FROM scored GROUP BY region, model""", d="mape")
def stream_resolve(spark, sf):
    s = fr.scored(spark, sf).select("region", "model", F.col("ts").alias("target_ts"), "predicted")
    a = fr.hourly(spark, sf).select("region", F.col("ts").alias("target_ts"), F.col("demand_mw").alias("actual"))
    out = drain(so.resolve(streamed(s, "predictions"), streamed(a, "actuals")), "resolved", mode="append")
    return out.filter("state = 'resolved'").groupBy("region", "model").agg(F.count("*").alias("resolved"), F.avg("abs_pct_error").alias("mape"))


@query("d2_stream_expiry", "scored", """
WITH p AS (SELECT region, model, ts, hour(ts) % 12 = 0 AS silent FROM scored)
SELECT region, model, count(*) FILTER (NOT silent) AS resolved, count(*) FILTER (silent) AS expired FROM p GROUP BY ALL""")
def stream_expiry(spark, sf):
    """Actuals never come for every twelfth hour; a last hour far ahead on both sides lets the watermark pass all of them."""
    s = fr.scored(spark, sf).select("region", "model", F.col("ts").alias("target_ts"), "predicted")
    a = fr.hourly(spark, sf).filter("hour(ts) % 12 <> 0").select("region", F.col("ts").alias("target_ts"), F.col("demand_mw").alias("actual"))
    bases, out, state = [scratch_path(spark, n) for n in ("predictions", "actuals")], scratch_path(spark, "expiry"), scratch_path(spark, "expiry-state")
    for k in range(3):
        end = F.lit("2024-03-01").cast("timestamp") + F.expr(f"INTERVAL {k} DAYS")
        for base, rows in zip(bases, (s, a)):
            tick = rows if k == 0 else rows.limit(1).withColumn("region", F.lit("end")).withColumn("target_ts", end)
            tick.write.mode("append").parquet(base)
        stream = so.resolve(stream_table(spark, bases[0], s.schema), stream_table(spark, bases[1], a.schema))
        update_log(stream, out, state, "append").awaitTermination()
    rows = spark.read.parquet(out).filter("region <> 'end'")
    return rows.groupBy("region", "model").agg(F.count_if(F.col("state") == "resolved").alias("resolved"), F.count_if(F.col("state") == "expired").alias("expired"))


@query("d5_stream_sliding_error", "scored", """
SELECT region, model, e AS window_end, avg(abs(actual - predicted) / actual * 100) AS mape, avg(200 * abs(actual - predicted) / (actual + predicted)) AS smape, count(*) AS n
FROM scored, LATERAL (SELECT unnest(generate_series(date_trunc('day', ts) + INTERVAL 1 DAY, date_trunc('day', ts) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS e) GROUP BY ALL""", d="mape smape")
def stream_sliding(spark, sf):
    s = fr.scored(spark, sf).select("region", "model", "ts", "actual", "predicted")
    return drain(so.sliding_error(streamed(s, "records"), step="1 day"), "sliding", ["region", "model", "window_end"])


def graded(spark, sf):
    """Ticks of graded records and revised actuals: revisions before and after their records, and an older capture that comes last."""
    s = fr.scored(spark, sf).withColumn("captured_at", F.col("ts"))
    r = revised(spark, sf)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("model", "string"), ("predicted", "double"), ("lead_hours", s.schema["lead_hours"].dataType.simpleString()), ("placeholder", "boolean"))]
    newer = r.select(*none, "region", "ts", "actual", (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("captured_at"))
    older = r.filter("hour(ts) % 7 <> 0").select(*none, "region", "ts", (F.col("actual") * 1.5).alias("actual"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("captured_at"))
    early, mid, last = ticks(s.select("region", "model", "ts", "predicted", "actual", "lead_hours", "placeholder", "captured_at"), ["region", "ts"])
    first, second, third = ticks(newer, ["ts", "region"])
    return in_ticks([early.unionByName(first), mid.unionByName(second).unionByName(older.filter("hour(ts) % 2 = 0")), last.unionByName(third), older.filter("hour(ts) % 2 = 1")],
                    "ledger", lambda rows, path: ledger.regrade_stream(rows, path, 6))


REGRADED = REVISED + """, regraded AS (SELECT s.* REPLACE (CASE WHEN now_mw > 0 AND round(now_mw, 2) <> round(actual, 2) THEN now_mw ELSE actual END AS actual) FROM scored s JOIN revised USING (region, ts)), """


@query("d5_stream_regraded_drift", "scored hourly", f"""WITH {REGRADED}{_spans(6).replace("FROM scored", "FROM regraded")}
SELECT a.region, a.model, r.n_records, a.smape AS rolling_smape_7d, b.smape AS rolling_smape_30d, a.mape AS rolling_mape_7d, b.mape AS rolling_mape_30d, a.n AS n_7d, b.n AS n_30d,
  a.low AS n_low_actual_excluded_7d, a.far AS n_lead_excluded_7d, a.unk AS n_lead_unknown_7d, a.ph AS n_anchor_placeholder_7d, a.phu AS n_anchor_unknown_7d
FROM blk a JOIN blk b USING (region, model) JOIN (SELECT region, model, count(*) AS n_records FROM scored GROUP BY ALL) r USING (region, model) WHERE a.span = '7d' AND b.span = '30d'""", d=BLOCK_D)
def stream_regraded_drift(spark, sf):
    return ledger.rolling_sums(spark, graded(spark, sf), now(), 6)


@query("d5_stream_regrade_stats", "scored hourly", f"""WITH {REVISED}
SELECT region, model, count(*) FILTER (moved) AS n_regraded, avg(abs(now_mw - actual) / now_mw * 100) FILTER (moved) AS mean_abs_shift_pct, max(abs(now_mw - actual) / now_mw * 100) FILTER (moved) AS max_abs_shift_pct
FROM (SELECT *, now_mw > 0 AND round(now_mw, 2) <> round(actual, 2) AS moved FROM scored JOIN revised USING (region, ts)) GROUP BY 1, 2""", d="mean_abs_shift_pct max_abs_shift_pct")
def stream_regrade_stats(spark, sf):
    return ledger.regraded_stats(ledger.read_records(spark, graded(spark, sf)))


@query("d6_stream_late_counters", "scored", f"""WITH {SNAPS}
SELECT date_trunc('day', logged_at) AS day, horizon, count(*) FILTER (t IS NULL) AS malformed, count(*) FILTER (t < TIMESTAMP '{NOW}' - INTERVAL 120 HOUR) AS expired, count(*) AS n
FROM (SELECT target_ts AS logged_at, horizon, CASE WHEN hour(target_ts) <> 5 THEN target_ts END AS t FROM snaps) GROUP BY 1, 2""")
def stream_counters(spark, sf):
    s = so.snapshots(forecasts(spark, sf)).select("horizon", F.col("target_ts").alias("logged_at"), F.when(F.hour("target_ts") != 5, F.col("target_ts")).alias("target_ts"))
    return drain(so.late_counters(streamed(s, "snaps"), now()), "counters", ["day", "horizon"])


@query("d6_dead_letters", "scored", f"""WITH {SNAPS},
l AS (SELECT horizon, CASE WHEN hour(target_ts) = 5 THEN 'unreadable' WHEN hour(target_ts) = 6 THEN 'missing target_ts' WHEN target_ts < TIMESTAMP '{NOW}' - INTERVAL 120 HOUR THEN 'expired' END AS reason FROM snaps)
SELECT coalesce(reason, 'kept') AS reason, CASE WHEN reason = 'unreadable' THEN 'unknown' ELSE horizon END AS horizon, count(*) AS n FROM l GROUP BY ALL""")
def dead_letter_stream(spark, sf):
    """Snapshots as lines of real files, streamed to two sinks; what each side got, by reason."""
    s = so.snapshots(forecasts(spark, sf)).select("horizon", F.when(F.hour("target_ts") != 6, F.col("target_ts")).alias("target_ts"), F.hour("target_ts").alias("_h"))
    base, path, state = (scratch_path(spark, n) for n in ("snapshot-lines", "dead-letters", "dead-letters-state"))
    for part in ticks(s, ["target_ts", "horizon", "_h"]):
        broken(part, F.col("_h") == 5, "horizon", "target_ts").write.mode("append").text(base)
        rows = files.json_rows(spark.readStream, "horizon STRING, target_ts TIMESTAMP", ["target_ts"], base)
        dead_letters(so.with_expiry(rows, now()), path, state).awaitTermination()
    good, bad = (spark.read.parquet(f"{path}/{side}") for side in ("good", "rejected"))
    both = good.select("horizon", F.lit("kept").alias("reason")).unionByName(bad.select("horizon", F.col("rejected").alias("reason")))
    return both.groupBy("reason", F.coalesce("horizon", F.lit("unknown")).alias("horizon")).agg(F.count("*").alias("n"))


@query("d8_stream_monotone_origin", "hourly", """
SELECT region, ts AS made_at, origin FROM (SELECT *, max(origin) OVER (PARTITION BY region ORDER BY ts) AS best FROM (SELECT region, ts, ts - to_hours(CASE WHEN hour(ts) % 5 = 0 THEN 4 ELSE 0 END) AS origin FROM hourly)) WHERE origin >= best""")
def stream_monotone(spark, sf):
    back = F.when(F.hour("ts") % 5 == 0, F.expr("INTERVAL 4 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    f = fr.hourly(spark, sf).select("region", F.col("ts").alias("made_at"), (F.col("ts") - back).alias("origin"))
    return in_ticks(ticks(f, ["made_at", "region"]), "monotone", lambda rows, path: late.monotone_origins(rows, WEEK, path))


@query("d9_stream_snapshot_fifo", "hourly", f"WITH {SNAP} SELECT region AS series, count(*) AS n, max(day)::TIMESTAMP AS newest, arg_max(hash, day) AS newest_hash FROM (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY region ORDER BY day DESC) <= 10) GROUP BY region")
def stream_fifo(spark, sf):
    s = snapshots(spark, sf).select(F.col("region").alias("series"), F.col("day").cast("timestamp").alias("scored_at"), tx.predictions_hash(F.col("predictions")).alias("hash"))
    out = in_ticks(ticks(s, ["scored_at", "series"]), "fifo", lambda rows, path: late.snapshot_fifo(rows, 10, WEEK, path))
    return out.select("series", F.size("hashes").alias("n"), F.array_max("scored_at").alias("newest"), F.element_at("hashes", -1).alias("newest_hash"))


@query("d10_stream_carried_ewma", "", f"""WITH RECURSIVE m AS (SELECT region || '|' || model AS series, trained_at, mape, row_number() OVER (PARTITION BY region, model ORDER BY trained_at) AS k
  FROM (SELECT region, model, trained_at, max(mape) AS mape FROM ({METADATA_SQL}) WHERE trained_at IS NOT NULL GROUP BY ALL)),
e AS (SELECT series, trained_at, k, mape, mape AS ewma FROM m WHERE k = 1 UNION ALL SELECT m.series, m.trained_at, m.k, m.mape, 0.3::DOUBLE * m.mape + 0.7::DOUBLE * e.ewma FROM e JOIN m ON e.series = m.series AND m.k = e.k + 1)
SELECT series, trained_at, mape, ewma FROM e""", d="mape ewma")
def stream_ewma(spark, sf):
    h = metadata(spark, sf).filter("trained_at IS NOT NULL").groupBy(F.concat_ws("|", "region", "model").alias("series"), "trained_at").agg(F.max("mape").alias("mape"))
    return in_ticks(ticks(h, ["trained_at", "series"]), "ewma", lambda rows, path: late.carried_ewma(rows, chunk_seconds=WEEK, path=path))


@query("d11_stream_breach_streaks", "hourly", """
SELECT region AS series, ts AS run_at, demand_mw > 150 AS breached, CASE WHEN demand_mw > 150 THEN row_number() OVER (PARTITION BY region, g, demand_mw > 150 ORDER BY ts) ELSE 0 END AS streak,
  CASE WHEN demand_mw > 150 THEN row_number() OVER (PARTITION BY region, g, demand_mw > 150 ORDER BY ts) ELSE 0 END >= 3 AS alert FROM (SELECT *, sum((demand_mw <= 150)::INT) OVER (PARTITION BY region ORDER BY ts) AS g FROM hourly)""", i="streak")
def stream_streaks(spark, sf):
    r = fr.hourly(spark, sf).select(F.col("region").alias("series"), F.col("ts").alias("run_at"), (F.col("demand_mw") > 150).alias("breached"))
    return in_ticks(ticks(r, ["run_at", "series"]), "streaks", lambda rows, path: late.breach_streaks(rows, chunk_seconds=WEEK, path=path))


@query("d11_recompute_cadence", "hourly", """
SELECT run_at, age_days, coalesce(age_days < 6, false) AS unexpected FROM (SELECT run_at, epoch(run_at - lag(run_at) OVER (ORDER BY run_at)) / 86400 AS age_days
  FROM (SELECT DISTINCT ts AS run_at FROM hourly WHERE hour(ts) = 3 AND day(ts) IN (2, 5, 11, 12, 19, 28)))""", d="age_days")
def cadence(spark, sf):
    """Recomputes at some nights of the month, of all regions seen at that hour."""
    night = (F.hour("ts") == 3) & F.dayofmonth("ts").isin(2, 5, 11, 12, 19, 28)
    runs = fr.hourly(spark, sf).groupBy(F.col("ts").alias("run_at")).agg(F.count_if(night).alias("recomputed"))
    return recompute_cadence(runs, 7)


@query("d12_guarded_upsert", "hourly", "SELECT region, ts, CASE WHEN day(ts) >= 20 THEN demand_mw + 1 ELSE demand_mw END AS demand_mw FROM hourly", d="demand_mw")
def guarded(spark, sf):
    """Two loads of one stream into the vintage table, the later reading moving the last value, behind the reseed guard."""
    h = fr.hourly(spark, sf).select("region", F.col("ts").alias("target_ts"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("captured_at"),
                                    F.col("demand_mw").alias("d"), F.lit(None).cast("double").alias("df"))
    later = h.filter(F.dayofmonth("target_ts") >= 20).withColumn("captured_at", F.col("captured_at") + F.expr("INTERVAL 1 DAY")).withColumn("d", F.col("d") + 1)
    path, base, state, marker = (scratch_path(spark, n) for n in ("guarded", "loads", "guarded-state", "guarded-written"))
    for part in (h, later):
        part.write.mode("append").parquet(base)
        vintage_stream(stream_table(spark, base, h.schema), path, state, 7, marker).awaitTermination()
    return read_vintages(spark, path).select("region", F.col("target_ts").alias("ts"), F.col("last_d").alias("demand_mw"))
