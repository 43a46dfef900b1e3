"""Streaming twins of the batch operators: windows and joins (keyed state is in ``late``, regrading in ``ledger``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.operators import metrics as mt
from loadstone.operators.drift import HORIZONS, PENDING_STALE_HOURS, horizon_snapshots


def hourly_totals(events: DataFrame, keys: Sequence[str], ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """Tumbling hourly sum with a lateness bound."""
    g = events.withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 hour")).agg(F.sum(value).alias(value), F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").alias("ts"), value, "n")


def activity_runs(events: DataFrame, keys: Sequence[str], ts: str, late: str = "2 hours") -> DataFrame:
    """Contiguous hourly runs as sessions; a missing hour ends a run."""
    hour = F.date_trunc("hour", F.col(ts))
    g = events.withColumn("_h", hour).withWatermark("_h", late).groupBy(*keys, F.session_window("_h", "1 hour 1 second")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("session_window.start").alias("start"), (F.col("session_window.end") - F.expr("INTERVAL 3601 SECONDS")).alias("end"), "n")


def snapshots(forecasts: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows at the origin plus a horizon; stateless, the batch filter as it is."""
    return horizon_snapshots(forecasts, horizons)


def first_snapshots(snaps: DataFrame, late_hours: int = PENDING_STALE_HOURS) -> DataFrame:
    """First made snapshot per region, target and horizon, and how many others were skipped.

    One aggregate with a watermark: it is the first made that stays, whichever came first, and what came for a
    target within the lateness bound is counted. Update mode gives the newest state of every snapshot.
    """
    keys = ["region", "target_ts", "horizon"]
    rest = [c for c in snaps.columns if c not in keys]
    order = ["made_at", *[c for c in rest if c != "made_at" and snaps.schema[c].dataType.typeName() != "map"]]  # equal times by the other columns
    first = F.min_by(F.struct(*rest), F.struct(*order))
    g = snaps.withWatermark("target_ts", f"{late_hours} hours").groupBy(*keys).agg(first.alias("_r"), (F.count("*") - 1).alias("skipped"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "skipped")


def resolve(predictions: DataFrame, actuals: DataFrame, late_hours: int = PENDING_STALE_HOURS) -> DataFrame:
    """Predictions joined to actuals of their hour; unmatched ones come out expired.

    Both sides carry the target hour as event time, so state older than the
    lateness bound is dropped.
    """
    p = predictions.withWatermark("target_ts", f"{late_hours} hours").alias("p")
    a = actuals.select(F.col("region").alias("a_region"), F.col("target_ts").alias("a_ts"), "actual").withWatermark("a_ts", f"{late_hours} hours")
    j = p.join(a, (F.col("region") == F.col("a_region")) & (F.col("target_ts") == F.col("a_ts")), "leftOuter")
    out = j.drop("a_region", "a_ts")
    return out.select("*", F.when(F.col("actual").isNull(), "expired").otherwise("resolved").alias("state"), mt.ape().alias("abs_pct_error"))


def sliding_error(records: DataFrame, keys: Sequence[str] = ("region", "model"), span: str = "7 days", step: str = "1 hour", late: str = "120 hours") -> DataFrame:
    """Mean error over a sliding window, one row per step."""
    g = records.withWatermark("ts", late).groupBy(*keys, F.window("ts", span, step)).agg(
        F.avg(mt.ape()).alias("mape"), F.avg(mt.smape_row()).alias("smape"), F.count("*").alias("n"))
    return g.select(*keys, F.col("window.end").alias("window_end"), "mape", "smape", "n")


def with_expiry(rows: DataFrame, now: Column, target: str = "target_ts") -> DataFrame:
    """Adds ``expired`` to the reasons of ``rejected``: the target lies longer back than an actual may take."""
    old = F.col(target) < now - F.make_dt_interval(F.lit(0), F.lit(PENDING_STALE_HOURS))
    return rows.withColumn("rejected", F.coalesce("rejected", F.when(old, "expired")))


def late_counters(snaps: DataFrame, now: Column, late: str = "7 days") -> DataFrame:
    """Expired and malformed snapshots per horizon and day of logging."""
    old = F.col("target_ts") < now - F.make_dt_interval(F.lit(0), F.lit(PENDING_STALE_HOURS))
    return snaps.withWatermark("logged_at", late).groupBy(F.window("logged_at", "1 day"), F.coalesce("horizon", F.lit("unknown")).alias("horizon")).agg(
        F.count_if(F.col("target_ts").isNull()).alias("malformed"), F.count_if(old).alias("expired"), F.count("*").alias("n")).select(
        F.col("window.start").alias("day"), "horizon", "malformed", "expired", "n")
