"""Seasonal baselines, forecast start, long-horizon and serve-path checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.operators import metrics as mt
from loadstone.operators.quantiles import percentiles
from loadstone.operators.series import hour_number, newest

# Fixed values.
LAG_HOURS = 24
SUBSTITUTION_POINTS = 2.0
SUBSTITUTION_HOURS = 24 * 7
FLOOR_FRACTION = 0.5
CEIL_FRACTION = 1.6
DRIFT_FRACTION = 0.40
MIN_RECENT_ROWS = 7 * 24
DRIFT_MIN_LENGTH = 360
DRIFT_R2 = 0.95
GUARD_HORIZONS = (24, 168, 720)
SPAN_ROWS = 168


def seasonal_naive(df: DataFrame, horizon: int, lag: int = LAG_HOURS, keys: Sequence[str] = ("region",), ts: str = "ts", v: str = "demand_mw") -> DataFrame:
    """Value one whole number of periods back at every future hour.

    Per series and phase of the period the newest known value is one partial
    aggregate (``max_by``); series shorter than a period, or with an empty phase,
    give no rows.
    """
    keys = list(keys)
    h = hour_number(ts)
    ends = df.groupBy(*keys).agg(F.max(h).alias("_last"), (F.max(h) - F.min(h) + 1).alias("_n")).filter(F.col("_n") >= lag)
    known = df.filter(F.col(v).isNotNull()).groupBy(*keys, F.pmod(h, F.lit(lag)).alias("_phase")).agg(F.max_by(v, h).alias("predicted"))
    full = known.groupBy(*keys).agg((F.count("*") >= min(lag, horizon)).alias("_full")).filter("_full").select(*keys)
    steps = ends.select(*keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lead_hours"))
    steps = steps.withColumn("_phase", F.pmod(F.col("_last") + F.col("lead_hours"), F.lit(lag)))
    return steps.join(known, [*keys, "_phase"]).join(full, keys, "left_semi").select(
        *keys, F.timestamp_seconds((F.col("_last") + F.col("lead_hours")) * 3600).alias(ts), "lead_hours", "predicted")


def skill(model_mape: Column, baseline_mape: Column) -> Column:
    return F.when(baseline_mape > 0, F.round(1 - model_mape / baseline_mape, 4))


def serve_baseline(points: Column, n_hours: Column) -> Column:
    """Reason of the substitution decision; ``serve`` when the baseline is to be used."""
    return (
        F.when(points.isNull(), "not_measurable").when(n_hours < SUBSTITUTION_HOURS, "too_few_hours")
        .when(points > -SUBSTITUTION_POINTS, "within_points").otherwise("serve"))


def sanity(forecast: DataFrame, recent: DataFrame, keys: Sequence[str] = ("region",), horizons: Sequence[int] = GUARD_HORIZONS) -> DataFrame:
    """Long-horizon sanity of every prefix of a forecast.

    ``forecast`` holds key, lead_hours, predicted; ``recent`` the observed values
    defining the band. One row per key and prefix length the forecast covers.
    """
    keys = list(keys)
    band = recent.filter("demand_mw > 0").groupBy(*keys).agg(
        F.count("*").alias("_rn"), F.min("demand_mw").alias("_rmin"), F.max("demand_mw").alias("_rmax"), F.avg("demand_mw").alias("_rmean"))
    length = forecast.groupBy(*keys).agg(F.max("lead_hours").alias("_len"))
    prefixes = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("prefix")
    rows = forecast.join(length, keys).select("*", prefixes).filter("prefix <= _len AND lead_hours <= prefix")
    bad = F.col("predicted").isNull() | F.isnan("predicted") | (F.abs("predicted") == float("inf"))
    day = F.floor((F.col("lead_hours") - 1) / 24)
    daily = rows.withColumn("_day", day).groupBy(*keys, "prefix", "_day").agg(
        F.avg("predicted").alias("_d"), F.count("*").alias("_c"), F.min("predicted").alias("_min"), F.max("predicted").alias("_max"), F.count_if(bad).alias("_bad"))
    whole = F.when(F.col("_c") == 24, F.col("_d"))
    per = daily.groupBy(*keys, "prefix").agg(
        F.min("_min").alias("fmin"), F.max("_max").alias("fmax"), F.sum("_bad").alias("n_bad"),
        F.min_by(whole, F.when(whole.isNotNull(), F.col("_day"))).alias("_first"), F.max_by(whole, F.when(whole.isNotNull(), F.col("_day"))).alias("_lastd"),
        F.regr_r2(whole, F.col("_day").cast("double")).alias("_r2"))
    j = per.join(band, keys, "left")
    reason = (
        F.when(F.col("_rn").isNull() | (F.col("_rn") < MIN_RECENT_ROWS), None).when(F.col("n_bad") > 0, "non_finite")
        .when(F.col("fmin") < FLOOR_FRACTION * F.col("_rmin"), "below_recent_band").when(F.col("fmax") > CEIL_FRACTION * F.col("_rmax"), "above_recent_band")
        .when((F.col("prefix") >= DRIFT_MIN_LENGTH) & (F.abs(F.col("_lastd") - F.col("_first")) > DRIFT_FRACTION * F.col("_rmean")) & (F.coalesce("_r2", F.lit(0.0)) > DRIFT_R2), "sustained_drift"))
    return j.select(*keys, "prefix", "fmin", "fmax", reason.alias("reason"))


def max_ok_horizon(prefixes: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Longest passing prefix, first failing one and its reason."""
    fail = F.col("reason").isNotNull()
    return prefixes.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(~fail, F.col("prefix"))), F.lit(0)).alias("max_ok_horizon"), F.min(F.when(fail, F.col("prefix"))).alias("flagged_horizon"),
        F.min_by("reason", F.when(fail, F.col("prefix"))).alias("reason"))


def bridge(featured_end: DataFrame, demand: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts", v: str = "demand_mw") -> DataFrame:
    """Contiguous real hours right after the last featured hour.

    An hour belongs when as many real hours lie between the two as the clock says,
    so the run ends at the first hour that is not followed by its successor. The
    first break is one aggregate; nothing is walked.
    """
    keys = list(keys)
    hour = F.expr("INTERVAL 1 HOUR")
    tail = demand.filter(F.col(v) > 0).join(featured_end.select(*keys, "last_featured_ts"), keys).filter(F.col(ts) > F.col("last_featured_ts"))
    tail = tail.select(*keys, ts, v, "last_featured_ts")
    after = tail.select(*keys, (F.col(ts) + hour).alias(ts)).unionByName(
        tail.select(*keys, (F.col("last_featured_ts") + hour).alias(ts)).distinct())
    first_break = after.join(tail.select(*keys, ts), [*keys, ts], "left_anti").groupBy(*keys).agg(F.min(ts).alias("_break"))
    return tail.join(first_break, keys).filter(F.col(ts) < F.col("_break")).select(*keys, ts, v)


def forecast_start(featured_end: DataFrame, demand: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts", v: str = "demand_mw") -> DataFrame:
    """Start hour, the term that bound it and the length of the bridge."""
    keys = list(keys)
    hour = F.expr("INTERVAL 1 HOUR")
    real = demand.filter(F.col(v) > 0).groupBy(*keys).agg(F.max(ts).alias("last_real"))
    b = bridge(featured_end, demand, keys, ts, v).groupBy(*keys).agg(F.max(ts).alias("_end"), F.count("*").alias("bridge_hours"))
    j = featured_end.join(real, keys, "left").join(b, keys, "left")
    feat, last = F.col("last_featured_ts"), F.col("last_real")
    anchor = F.when(last.isNull(), feat).when((feat < last) & F.col("_end").isNotNull(), F.col("_end")).otherwise(F.least(feat, last))
    term = (
        F.when(last.isNull(), "no_real_demand").when(anchor == last, "real_demand").when(anchor == feat, "featured").otherwise("featured_bridged"))
    return j.select(*keys, (anchor + hour).alias("forecast_start"), term.alias("binding_term"), F.coalesce("bridge_hours", F.lit(0)).alias("bridge_hours"))


def anchor_provenance(starts: DataFrame, featured: DataFrame, raw: DataFrame, conditioned: DataFrame, placeholders: DataFrame,
                      keys: Sequence[str] = ("region",)) -> DataFrame:
    """Value, placeholder flag and conditioned flag of the hour before the start."""
    keys = list(keys)
    a = starts.select(*keys, (F.col("forecast_start") - F.expr("INTERVAL 1 HOUR")).alias("ts"))

    def at(df, name):
        return df.filter("demand_mw > 0").select(*keys, "ts", F.col("demand_mw").alias(name))

    on = [*keys, "ts"]
    j = a.join(at(featured, "_f"), on, "left").join(at(raw, "_r"), on, "left").join(at(conditioned, "_c"), on, "left").join(
        placeholders.select(*on, F.col("placeholder").alias("anchor_was_placeholder")), on, "left")
    changed = F.when(F.col("_c").isNotNull(), ~F.col("_c").eqNullSafe(F.col("_r")))
    return j.select(*keys, F.col("ts").alias("anchor_ts"), F.round(F.coalesce("_f", "_c", "_r"), 2).alias("anchor_mw"), "anchor_was_placeholder", changed.alias("anchor_conditioned"))


def window_contiguity(stamps: DataFrame, origins: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts", span: int = SPAN_ROWS) -> DataFrame:
    """Do the newest rows cover exactly the hours before the origin, and if not why."""
    keys = list(keys)
    tail = newest(stamps.select(*keys, ts), keys, ts, span).groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"), F.count("*").alias("_n"))
    j = origins.join(tail, keys, "left")
    gap = F.floor((F.unix_timestamp("origin") - 3600 - F.unix_timestamp("_b")) / 3600)
    whole = (F.col("_n") == span) & (gap == 0) & ((F.unix_timestamp("_b") - F.unix_timestamp("_a")) / 3600 == span - 1)
    reason = (
        F.when(F.col("_n").isNull(), "unusable").when(whole, "identical").when(F.col("_n") < span, "unusable").when(gap > 0, "seed_tail_short").otherwise("hole_in_lookback"))
    return j.select(*keys, reason.alias("reason"), gap.alias("gap_hours"))


def gap_frame(featured: DataFrame, future: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts") -> DataFrame:
    """Feature rows strictly between the anchor end and the start, then the future rows."""
    cols = [c for c in future.columns if c in featured.columns]
    gap = featured.join(bounds, list(keys)).filter((F.col(ts) > F.col("anchor_end")) & (F.col(ts) < F.col("start"))).select(*cols)
    return gap.withColumn("part", F.lit("gap")).unionByName(future.select(*cols).withColumn("part", F.lit("future")))


def gap_actuals(featured: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts", v: str = "demand_mw") -> DataFrame:
    """Known demand from the start of the gap up to its first unknown row."""
    gap = featured.join(bounds, list(keys)).filter((F.col(ts) > F.col("anchor_end")) & (F.col(ts) < F.col("start")))
    first_null = gap.filter(F.col(v).isNull()).groupBy(*keys).agg(F.min(ts).alias("_cut"))
    return gap.join(first_null, list(keys), "left").filter(F.col("_cut").isNull() | (F.col(ts) < F.col("_cut"))).select(*keys, ts, v)


# Fixed values of the serve-path gate.
GATE = {"trough": 0.75, "level_min": 0.75, "level_max": 2.0, "median_ape_max": 25.0, "max_offset_failures": 1, "min_truth": 12}
PROBE_ANCHORS, PROBE_STEP_HOURS, PROBE_HORIZON_HOURS = 3, 24, 48


def serve_gate(probes: DataFrame, recent: DataFrame, gate: dict = GATE, keys: Sequence[str] = ("region",)) -> DataFrame:
    """One verdict per probe anchor, and the decision per series.

    ``probes`` holds key, anchor, predicted, actual (null when not yet observed);
    ``recent`` the week before each anchor (key, anchor, demand_mw).
    """
    keys = list(keys)
    k = [*keys, "anchor"]
    ref = recent.groupBy(*k).agg(F.avg("demand_mw").alias("_mean"), F.count("*").alias("_n"))
    p5 = percentiles(recent, k, {"_p5": (F.col("demand_mw"), 0.05)})
    real = F.col("actual") > 0
    ape = F.when(real, F.abs(F.col("predicted") - F.col("actual")) / F.col("actual") * 100)
    g = probes.groupBy(*k).agg(
        F.min("predicted").alias("_pmin"), F.avg("predicted").alias("_pmean"), F.count_if(real).alias("_real"),
        F.min(F.when(real, F.col("predicted"))).alias("_prmin"), F.min(F.when(real, F.col("actual"))).alias("_tmin"))
    med = percentiles(probes, k, {"_med": (ape, 0.5)})
    j = g.join(ref, k).join(p5, k).join(med, k, "left").filter(f"_n >= {SPAN_ROWS} AND _p5 > 0 AND _mean > 0")
    trough, level = F.col("_pmin") / F.col("_p5"), F.col("_pmean") / F.col("_mean")
    judged = F.col("_real") >= gate["min_truth"]
    ok = F.when(judged, (F.col("_med") <= gate["median_ape_max"]) & (F.col("_prmin") / F.col("_tmin") >= gate["trough"])).otherwise(
        (trough >= gate["trough"]) & level.between(gate["level_min"], gate["level_max"]))
    return j.select(*k, trough.alias("trough_ratio"), level.alias("level_ratio"), F.when(judged, F.col("_med")).alias("truth_median_ape"), ok.alias("ok"))


def gate_decision(verdicts: DataFrame, gate: dict = GATE, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Every live anchor passes and at most the allowed number fails in all."""
    live = F.col("truth_median_ape").isNull()
    return verdicts.groupBy(*keys).agg(
        F.count("*").alias("n_anchors"), F.count_if(~F.col("ok")).alias("n_failures"),
        (F.coalesce(F.bool_and(F.when(live, F.col("ok"))), F.lit(True)) & (F.count_if(~F.col("ok")) <= gate["max_offset_failures"])).alias("passed"))


def naive_error(df: DataFrame, keys: Sequence[str], lagged: str = "lag") -> DataFrame:
    return df.groupBy(*keys).agg(mt.positive_mape("demand_mw", lagged).alias("baseline_mape"))
