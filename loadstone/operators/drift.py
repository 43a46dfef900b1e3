"""Drift: grading served forecasts against what was later observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.operators import metrics as mt
from loadstone.operators.cleaning import LOW_ACTUAL_FRACTION, drop_low_actuals, keep_lead, within_hours
from loadstone.operators.quantiles import percentiles
from loadstone.operators.series import newest, running, windowed

# Fixed values.
WINDOW_7D = 24 * 7
WINDOW_30D = 24 * 30
HEADLINE_LEAD = 1
HORIZONS = (24, 48, 72)
PENDING_STALE_HOURS = 72 + 48
DIAGNOSTICS_HOURS = 24 * 7
MAPE_BANDS = {
    "1h": (1.0, 2.5, 5.0, 8.0), "24h": (2.0, 3.5, 7.0, 12.0), "48h": (3.0, 5.0, 10.0, 15.0),
    "72h": (4.0, 6.5, 12.0, 18.0), "7d": (6.0, 9.0, 15.0, 22.0),
}
GATE_HYSTERESIS_PTS = 3.0


def grade(mape: Column, horizon: str | Column = "48h") -> Column:
    """excellent, target, acceptable or rollback by the horizon's bands."""
    h = F.lit(horizon) if isinstance(horizon, str) else horizon
    bands = F.create_map(*[x for k, v in MAPE_BANDS.items() for x in (F.lit(k), F.array(*[F.lit(b) for b in v]))])
    b = F.coalesce(bands[h], F.array(*[F.lit(x) for x in MAPE_BANDS["48h"]]))
    return F.when(mape <= b[0], "excellent").when(mape <= b[1], "target").when(mape <= b[2], "acceptable").when(mape.isNotNull(), "rollback")


def newest_match(forecast: DataFrame, actuals: DataFrame) -> DataFrame:
    """One record per region and model at the newest observed hour of its forecast.

    ``forecast`` holds region, target_ts, preds (map of model to MW) and origin.
    """
    hit = forecast.join(actuals.filter(F.col("actual").isNotNull() & ~F.isnan("actual")), ["region", "target_ts"])
    last = hit.groupBy("region").agg(F.max_by(F.struct("target_ts", "origin", "preds", "actual"), "target_ts").alias("r")).select("region", "r.*")
    rec = last.select("region", "target_ts", "origin", "actual", F.explode("preds").alias("model", "predicted"))
    lead = (F.unix_timestamp("target_ts") - F.unix_timestamp("origin")) / 3600 + 1
    return rec.filter("predicted IS NOT NULL AND actual <> 0").select(
        "region", "model", "target_ts", "predicted", "actual", mt.ape().alias("abs_pct_error"), mt.smape_row().alias("smape"),
        F.when(lead >= 1, lead.cast("long")).alias("lead_hours"))


def resolve_pending(pending: DataFrame, actuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots whose hour is now observed (one row a model) and those still waiting."""
    usable = actuals.filter("actual > 0")
    done = pending.join(usable, ["region", "target_ts"]).select(
        "region", "target_ts", "horizon", "actual", F.explode("preds").alias("model", "predicted"))
    still = pending.join(usable, ["region", "target_ts"], "left_anti")
    return done.select("*", mt.ape().alias("abs_pct_error")), still


def expire(pending: DataFrame, now: Column) -> DataFrame:
    """Counts per horizon: kept, expired and malformed snapshots."""
    old = F.col("target_ts") < now - F.make_dt_interval(F.lit(0), F.lit(PENDING_STALE_HOURS))
    bad = F.col("target_ts").isNull()
    return pending.groupBy(F.coalesce("horizon", F.lit("unknown")).alias("horizon")).agg(
        F.count_if(~bad & ~old).alias("kept"), F.count_if(~bad & old).alias("expired"), F.count_if(bad).alias("malformed"))


def horizon_snapshots(forecast: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows of each scored forecast exactly at the origin plus a horizon."""
    lead = (F.unix_timestamp("target_ts") - F.unix_timestamp("origin")) / 3600
    return forecast.filter(lead.isin(*horizons)).withColumn("horizon", F.concat(lead.cast("int").cast("string"), F.lit("h")))


def dedup_snapshots(snapshots: DataFrame, keys: Sequence[str] = ("region", "target_ts", "horizon"), made: str = "made_at") -> DataFrame:
    """First snapshot of a (target, horizon) wins; ``skipped`` counts the others."""
    first = F.min_by(F.struct(*[c for c in snapshots.columns if c not in keys]), F.col(made))
    return snapshots.groupBy(*keys).agg(first.alias("r"), (F.count("*") - 1).alias("skipped")).select(*keys, "r.*", "skipped")


def regrade(records: DataFrame, actuals: DataFrame) -> DataFrame:
    """Actual replaced where the current positive value differs at two decimals.

    ``shift_pct`` is null on untouched rows.
    """
    j = records.join(actuals.select("region", "ts", F.col("actual").alias("_new")), ["region", "ts"], "left")
    moved = F.coalesce((F.col("_new") > 0) & (F.round("_new", 2) != F.round("actual", 2)), F.lit(False))
    shift = F.when(moved, F.abs(F.col("_new") - F.col("actual")) / F.col("_new") * 100)
    out = j.select(*[F.when(moved, F.col("_new")).otherwise(F.col("actual")).alias("actual") if c == "actual" else F.col(c) for c in records.columns],
                   moved.alias("regraded"), shift.alias("shift_pct"))
    return out.select("*", mt.ape().alias("abs_pct_error"), mt.smape_row().alias("smape"))


def regrade_stats(regraded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return regraded.groupBy(*keys).agg(
        F.count_if("regraded").alias("n_regraded"), F.avg("shift_pct").alias("mean_abs_shift_pct"), F.max("shift_pct").alias("max_abs_shift_pct"))


def rolling_block(records: DataFrame, now: Column, keys: Sequence[str] = ("region", "model"), max_lead: int | None = HEADLINE_LEAD,
                  max_records: int | None = None, fraction: float = LOW_ACTUAL_FRACTION) -> DataFrame:
    """7- and 30-day error with lead and low-actual filters, and their counts.

    With ``max_records`` only the newest records of a key are held; the low-actual median of a window is
    taken over its lead-filtered rows.
    """
    keys = list(keys)
    kept = records if max_records is None else newest(records, keys, "ts", max_records)
    n = kept.groupBy(*keys).agg(F.count("*").alias("n_records"))
    spans = F.array(*[F.struct(F.lit(name).alias("span"), F.lit(h).alias("hours")) for name, h in (("7d", WINDOW_7D), ("30d", WINDOW_30D))])
    x = kept.select("*", F.inline(spans)).filter(F.col("ts") >= now - F.make_dt_interval(F.lit(0), F.col("hours")))
    lead_ok = keep_lead(max_lead) if max_lead is not None else F.lit(True)
    med = percentiles(x.filter(lead_ok), [*keys, "span"], {"_median": (F.abs("actual"), 0.5)})
    y = x.join(med, [*keys, "span"], "left").withColumn("_ok", lead_ok & (F.abs("actual") >= fraction * F.col("_median")))
    per = y.groupBy(*keys, "span").agg(
        F.avg(F.when(F.col("_ok"), mt.ape())).alias("mape"), F.avg(F.when(F.col("_ok"), mt.smape_row())).alias("smape"),
        F.count_if("_ok").alias("n"), F.count_if(lead_ok & ~F.col("_ok")).alias("low_actual_excluded"), F.count_if(~lead_ok).alias("lead_excluded"),
        F.count_if(F.col("lead_hours").isNull()).alias("lead_unknown"),
        F.count_if(F.col("_ok") & F.col("placeholder")).alias("anchor_placeholder"), F.count_if(F.col("_ok") & F.col("placeholder").isNull()).alias("anchor_unknown"))

    def pick(c, span):
        return F.max(F.when(F.col("span") == span, F.col(c)))

    wide = per.groupBy(*keys).agg(
        *[pick(m, s).alias(f"rolling_{m}_{s}") for m in ("smape", "mape") for s in ("7d", "30d")],
        *[F.coalesce(pick("n", s), F.lit(0)).alias(f"n_{s}") for s in ("7d", "30d")],
        *[F.coalesce(pick(c, "7d"), F.lit(0)).alias(f"n_{c}_7d") for c in ("low_actual_excluded", "lead_excluded", "lead_unknown", "anchor_placeholder", "anchor_unknown")])
    return n.join(wide, keys, "left")


def running_error(records: DataFrame, keys: Sequence[str] = ("region", "model"), span: int = WINDOW_7D) -> DataFrame:
    """Trailing mean error at every record, by hour range on haloed chunks."""
    x = records.withColumn("_h", F.floor(F.unix_timestamp("ts") / 3600))
    return windowed(x, keys, "_h", {
        "running_mape": lambda w: F.avg(mt.ape()).over(w.rangeBetween(-span, 0)),
        "running_n": lambda w: F.count("*").over(w.rangeBetween(-span, 0))}, before=span).drop("_h")


def reconcile(records: DataFrame, settled: DataFrame, displayed: DataFrame, now: Column, window: int = WINDOW_7D, max_lead: int = HEADLINE_LEAD,
              fraction: float = LOW_ACTUAL_FRACTION, min_samples: int = 24, max_divergence: float = 2.0, max_revision: float = 5.0) -> DataFrame:
    """Displayed error against the same hours regraded on settled actuals."""
    keys = ["region", "model"]
    rows = records.filter(within_hours(now, window) & keep_lead(max_lead) & (F.col("actual") > 0))
    j = rows.join(settled.filter("settled > 0").select("region", "ts", "settled"), ["region", "ts"])
    j = j.withColumn("revision", F.abs(F.col("settled") - F.col("actual")) / F.col("settled") * 100)
    rev = j.groupBy(*keys).agg(F.avg("revision").alias("mean_abs_revision_pct"))
    kept = drop_low_actuals(j, keys, "settled", fraction)
    m = kept.groupBy(*keys).agg(F.avg(mt.ape("settled", "predicted")).alias("settled_mape"), F.count("*").alias("n_compared"))
    out = displayed.select(*keys, "displayed_mape").join(m, keys, "left").join(rev, keys, "left").na.fill(0, ["n_compared"])
    enough = F.col("n_compared") >= min_samples
    div = F.when(enough, F.abs(F.col("displayed_mape") - F.col("settled_mape")))
    reasons = F.array_compact(F.array(
        F.when(div > max_divergence, F.when(F.col("displayed_mape") > F.col("settled_mape"), "displayed_overstates").otherwise("displayed_understates")),
        F.when(enough & (F.col("mean_abs_revision_pct") > max_revision), "high_eia_revision")))
    return out.select("*", div.alias("divergence_pct_points"), reasons.alias("reasons"),
                      F.when(~enough, "insufficient_settled_overlap").alias("skipped"), (F.size(reasons) == 0).alias("ok"))


def champions(records: DataFrame, keys: Sequence[str], window: int = WINDOW_7D, min_records: int = 24) -> DataFrame:
    """Model with the lowest WAPE per disjoint window counting back from the newest hour."""
    last = records.groupBy(*keys).agg(F.max("ts").alias("_last"), F.count_distinct("model").alias("_models"))
    x = records.join(last, list(keys)).withColumn(
        "window_no", F.floor((F.unix_timestamp("_last") - F.unix_timestamp("ts")) / (3600 * window)))
    per = x.groupBy(*keys, "window_no", "model", "_models").agg(mt.wape().alias("wape"), F.count("*").alias("n")).filter(F.col("n") >= min_records)
    best = F.min_by("model", F.struct("wape", "model"))
    return per.groupBy(*keys, "window_no", "_models").agg(best.alias("champion"), F.min("wape").alias("wape"), F.count("*").alias("_seen")).filter(
        "_seen = _models").drop("_seen", "_models")


def champion_flips(champ: DataFrame, keys: Sequence[str]) -> DataFrame:
    return champ.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_distinct("champion").alias("n_champions")).select(
        *keys, "n_windows", F.when(F.col("n_windows") >= 2, F.col("n_champions") > 1).alias("flipped"))


def visibility(history: DataFrame, keys: Sequence[str], order: str, mape: str, bar: float = MAPE_BANDS["7d"][3], band: float = GATE_HYSTERESIS_PTS) -> DataFrame:
    """Visible flag with hysteresis over a history of best errors.

    Hidden above the bar, visible again only at or below the bar minus the band.
    Between the two the last decisive row counts, so no fold over the series is
    needed: the state is the newest row outside the band, visible by default.
    """
    m = F.col(mape)
    decisive = F.when(m > bar, False).when(m <= bar - band, True)
    return running(history, keys, order, {"_state": ("last", decisive)}).withColumn("visible", F.coalesce("_state", F.lit(True))).drop("_state")


def live_verdict(per_model: DataFrame, horizon: str = "24h", keys: Sequence[str] = ("region",)) -> DataFrame:
    """Champion by rolling error at a horizon, its grade and the gate disagreement."""
    best = per_model.filter("rolling_mape IS NOT NULL").groupBy(*keys).agg(
        F.min_by("model", F.struct("rolling_mape", "model")).alias("champion"), F.min("rolling_mape").alias("champion_mape"), F.count("*").alias("n_models"))
    return best.withColumn("grade", grade(F.col("champion_mape"), horizon))


def diagnostics_totals(log: DataFrame, now: Column, counters: Sequence[str]) -> DataFrame:
    """Counters of the last seven days per horizon."""
    return log.filter(F.col("logged_at") >= now - F.make_dt_interval(F.lit(0), F.lit(DIAGNOSTICS_HOURS))).groupBy("horizon").agg(
        *[F.sum(c).alias(c) for c in counters])


def coverage_channels(window: DataFrame, resolved: DataFrame, pending: DataFrame, origins: DataFrame) -> DataFrame:
    """Each hour of the window: resolved, pending, skip, freeze or unknown; fleet row last.

    ``origins`` holds the served origin per hour; an hour whose forecast origin a
    day earlier equals the one before it was skipped, otherwise frozen.
    """
    day = F.expr("INTERVAL 24 HOURS")
    o = origins.select("region", (F.col("ts") + day).alias("ts"), F.col("origin").alias("_o"))
    p = origins.select("region", (F.col("ts") + day + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("origin").alias("_p"))
    j = (
        window.join(resolved.select("region", "ts", F.lit(True).alias("_res")).distinct(), ["region", "ts"], "left")
        .join(pending.select("region", "ts", F.lit(True).alias("_pen")).distinct(), ["region", "ts"], "left")
        .join(o, ["region", "ts"], "left").join(p, ["region", "ts"], "left"))
    channel = (
        F.when(F.col("_res"), "resolved").when(F.col("_pen"), "pending").when(F.col("_o").isNull() | F.col("_p").isNull(), "unknown")
        .when(F.col("_o") == F.col("_p"), "skip").otherwise("freeze"))
    x = j.withColumn("channel", channel)
    return x.rollup("region").agg(*[F.count_if(F.col("channel") == c).alias(c) for c in ("resolved", "skip", "freeze", "pending", "unknown")]).withColumn(
        "region", F.coalesce("region", F.lit("FLEET")))


def monotone_origins(forecasts: DataFrame, keys: Sequence[str] = ("region",), order: str = "made_no") -> DataFrame:
    """Forecasts whose origin is not before any origin served earlier."""
    sec = F.unix_timestamp("origin")
    return running(forecasts, keys, order, {"_max": ("max", sec)}).filter(sec >= F.col("_max")).drop("_max")

