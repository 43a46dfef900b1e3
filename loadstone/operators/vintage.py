"""Data vintages: what was first seen, what it settled to, and what that implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadstone.operators.quantiles import percentiles
from loadstone.operators.series import hour_number, lead_hours, newest, previous

# Fixed values.
RETENTION_HOURS = 24 * 30
REVISION_EPSILON_MW = 0.5
FRESH_LAG_HOURS = 3
MIN_FRESH = 24
BROKEN_REVISION_PCT = 25.0
CHURN_FRACTION = 0.5
BULK_BACKFILLED = 5
CLEAN_FRACTION = 0.1
CLEAN_REVISION_PCT = 2.0
STUB_EPSILON_MW = 0.01
DF_REVISION_EPSILON_MW = 0.5
MAX_GAP_HOURS = 168.0
MIN_ABSENT_HOURS = 20
MIN_PAIRED_HOURS = 200
MIN_OFFICIAL_HOURS = 50
UNSCOREABLE = ("broken",)

KEYS = ("region", "target_ts")


def usable_readings(readings: DataFrame, retention_hours: int | None = RETENTION_HOURS) -> DataFrame:
    """The positive readings that can change a vintage, one per target hour and capture.

    A reading that repeats the value before it and brings no first day-ahead value
    changes nothing and is left out, so an hour keeps as many readings as it has
    changes, however often the feed was polled. Captures later than
    ``retention_hours`` after the hour are left out too (none if it is null).
    """
    kept = F.col("d") > 0
    if retention_hours is not None:
        kept &= F.col("captured_at") <= F.col("target_ts") + F.make_dt_interval(F.lit(0), F.lit(retention_hours))
    one = (
        readings.filter(kept).repartition(*KEYS)  # serves the aggregate, the window and the fold
        .withColumn("df", F.when(~F.isnan("df") & (F.abs("df") < float("inf")), F.col("df")))
        .groupBy(*KEYS, "captured_at").agg(F.max(F.struct("d", "df")).alias("r"))
        .select(*KEYS, "captured_at", "r.d", "r.df")
    )
    in_order = Window.partitionBy(*KEYS).orderBy("captured_at")
    published = F.count("df").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) > 0
    same = F.coalesce(F.col("d") == F.lag("d").over(in_order), F.lit(False))
    return one.withColumn("_idle", same & (F.col("df").isNull() | published)).filter("NOT _idle").drop("_idle")


COLUMNS = ["first_seen_d", "first_seen_df", "captured_at", "last_d", "n_updates", "df_at"]


def vintages(readings: DataFrame, prior: DataFrame | None = None, retention_hours: int | None = RETENTION_HOURS) -> DataFrame:
    """Fold the readings of each target hour in capture order.

    The first value is pinned, the last one moves only by more than half a
    megawatt, the first day-ahead value is filled once and dated by its capture.
    With ``prior`` vintages the fold goes on from them; hours without a new
    reading pass through.
    """
    rows = usable_readings(readings, retention_hours).groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("captured_at", "d", "df"))).alias("rows"))
    if prior is None:
        rows = rows.select("*", F.lit(None).cast(
            "struct<first_seen_d:double,first_seen_df:double,captured_at:timestamp,last_d:double,n_updates:bigint,df_at:timestamp>").alias("old"))
    else:
        rows = rows.join(prior.select(*KEYS, F.struct(*COLUMNS).alias("old")), list(KEYS), "full_outer")

    def step(acc, r):
        moved = F.abs(r["d"] - acc["last_d"]) > REVISION_EPSILON_MW
        return F.struct(
            F.when(moved, r["d"]).otherwise(acc["last_d"]).alias("last_d"),
            (acc["n"] + F.when(moved, F.lit(1)).otherwise(F.lit(0))).cast("long").alias("n"),
        )

    new = F.coalesce("rows", F.array().cast("array<struct<captured_at:timestamp,d:double,df:double>>"))
    first, old = F.get(new, F.lit(0)), F.col("old")
    start = F.struct(F.coalesce(old["last_d"], first["d"]).alias("last_d"), F.coalesce(old["n_updates"], F.lit(0)).cast("long").alias("n"))
    state = F.aggregate(new, start, step)
    df = F.get(F.filter(new, lambda r: r["df"].isNotNull()), F.lit(0))
    held = old["first_seen_df"].isNotNull()
    return rows.select(
        *KEYS, F.coalesce(old["first_seen_d"], first["d"]).alias("first_seen_d"), F.coalesce(old["first_seen_df"], df["df"]).alias("first_seen_df"),
        F.coalesce(old["captured_at"], first["captured_at"]).alias("captured_at"), state["last_d"].alias("last_d"), state["n"].alias("n_updates"),
        F.when(held, old["df_at"]).otherwise(df["captured_at"]).alias("df_at"),
    )


def revision_pct() -> Column:
    return F.when(F.col("last_d") > 0, F.abs(F.col("last_d") - F.col("first_seen_d")) / F.col("last_d") * 100)


def was_placeholder() -> Column:
    """The first value was the day-ahead value, seen at the same capture."""
    late = F.coalesce(F.col("df_at") != F.col("captured_at"), F.lit(False))
    return F.coalesce(~late & (F.col("first_seen_d") == F.col("first_seen_df")), F.lit(False))


def capture_lag() -> Column:
    return lead_hours("captured_at", "target_ts")


def df_capture_lag() -> Column:
    return lead_hours(F.coalesce("df_at", "captured_at"), F.col("target_ts"))


def summary(v: DataFrame) -> DataFrame:
    return v.groupBy("region").agg(
        F.count("*").alias("n_records"), F.count_if(was_placeholder()).alias("n_placeholder"),
        F.count_if(F.col("n_updates") > 0).alias("n_revised"), F.avg(revision_pct()).alias("mean_revision_pct"),
        F.max(revision_pct()).alias("max_revision_pct"), F.max("target_ts").alias("newest_hour"),
        F.max_by(was_placeholder(), "target_ts").alias("newest_was_placeholder"),
    )


def _class_parts() -> list[Column]:
    fresh, revised = capture_lag() <= FRESH_LAG_HOURS, F.col("n_updates") > 0
    return [
        F.count_if(fresh).alias("n_fresh"), F.count_if(~fresh & revised).alias("n_backfilled_revised"),
        F.round(F.try_divide(F.count_if(fresh & revised), F.count_if(fresh)), 4).alias("fresh_revised_fraction"),
        F.round(F.avg(F.when(fresh & revised, revision_pct())), 4).alias("mean_fresh_revision_pct"),
    ]


def _revision_class() -> Column:
    mean, frac = F.coalesce("mean_fresh_revision_pct", F.lit(0.0)), F.coalesce("fresh_revised_fraction", F.lit(0.0))
    return (
        F.when(F.col("n_fresh") < MIN_FRESH, "unknown")
        .when(F.col("mean_fresh_revision_pct") >= BROKEN_REVISION_PCT, "broken")
        .when(F.col("n_backfilled_revised") >= BULK_BACKFILLED, "bulk")
        .when(frac >= CHURN_FRACTION, "churn")
        .when((frac <= CLEAN_FRACTION) & (mean <= CLEAN_REVISION_PCT), "clean")
        .otherwise("unknown")
    )


def classify(v: DataFrame) -> DataFrame:
    """Revision class per region: broken, bulk, churn, clean or unknown."""
    return v.groupBy("region").agg(*_class_parts()).withColumn("revision_class", _revision_class())


def _span_parts() -> list[Column]:
    covered = F.when(F.col("first_seen_df").isNotNull(), F.col("target_ts"))
    return [F.min("target_ts").alias("_start"), F.max("target_ts").alias("_end"), F.min(covered).alias("_first"), F.max(covered).alias("_last")]


def _with_gaps(spans: DataFrame, v: DataFrame) -> DataFrame:
    """Gap columns beside the span columns of each region."""
    cov = v.filter("first_seen_df IS NOT NULL").select("region", "target_ts").withColumn("h", hour_number("target_ts"))
    step = previous(cov, ["region"], "h", {"_prev": "h"}).withColumn("step", F.col("h") - F.col("_prev"))
    longest = F.max(F.struct(
        (F.col("step") - 1).cast("double").alias("hours"), (-F.unix_timestamp("target_ts")).alias("earlier"), F.col("target_ts").alias("at")))
    inner = step.filter("step > 1").groupBy("region").agg(longest.alias("_inner"))
    lead, trail = lead_hours("_first", "_start"), lead_hours("_end", "_last")
    best = F.greatest(lead, trail, F.col("_inner.hours"))
    end = F.when(lead == best, F.col("_first")).when(trail == best, F.col("_end")).otherwise(F.col("_inner.at"))
    return spans.join(inner, "region", "left").select(
        *[c for c in spans.columns if c not in ("_start", "_end", "_first", "_last")], trail.alias("stale_hours"),
        F.col("_last").alias("last_published_at"), best.alias("longest_gap_hours"), F.when(best > 0, end).alias("longest_gap_end"))


def feed_gaps(v: DataFrame) -> DataFrame:
    """Leading, interior and trailing gaps of the day-ahead feed per region.

    Steps between covered hours are taken chunk by chunk, so no region's whole
    history is walked in one task.
    """
    return _with_gaps(v.groupBy("region").agg(*_span_parts()), v)


def _bias_parts() -> list[Column]:
    has, real = F.col("first_seen_df").isNotNull(), F.col("last_d") > 0
    return [F.avg(F.when(has & real, F.col("last_d"))).alias("_covered"), F.avg(F.when(~has & real, F.col("last_d"))).alias("_absent"),
            F.count_if(~has & real).alias("n_absent")]


def _bias() -> Column:
    return F.when((F.col("n_absent") >= MIN_ABSENT_HOURS) & (F.col("_covered") > 0),
                  F.round((F.col("_absent") - F.col("_covered")) / F.col("_covered") * 100, 2)).alias("absent_hours_bias_pct")


def absent_bias(v: DataFrame) -> DataFrame:
    """Load on hours without a day-ahead value against hours with one, percent."""
    return v.groupBy("region").agg(*_bias_parts()).select("region", "n_absent", _bias())


def scoreability(v: DataFrame) -> DataFrame:
    """Can a region be scored, and if not why; with its coverage evidence.

    Class, coverage, bias and span come from one aggregate over the vintages.
    """
    has, n = F.col("first_seen_df").isNotNull(), F.count("*")
    cover = [
        F.round(F.count_if(has) / n, 4).alias("df_coverage"),
        F.round(F.count_if(has & (df_capture_lag() <= FRESH_LAG_HOURS)) / n, 4).alias("df_asissued_coverage"),
        F.round(F.count_if(was_placeholder()) / n * 100, 2).alias("placeholder_pct"), n.alias("n_hours"), F.count_if(~has).alias("n_absent_hours"),
    ]
    spans = v.groupBy("region").agg(*cover, *_class_parts(), *_bias_parts(), *_span_parts())
    names = ["df_coverage", "df_asissued_coverage", "placeholder_pct", "n_hours", "n_absent_hours"]
    out = _with_gaps(spans, v).select("region", *names, "stale_hours", "last_published_at", "longest_gap_hours", "longest_gap_end", _bias(), _revision_class().alias("revision_class"))
    gap = F.col("longest_gap_hours")
    reason = F.when(F.col("revision_class").isin(*UNSCOREABLE), "broken-feed").when(gap.isNull() | (gap > MAX_GAP_HOURS), "df-feed-gap")
    return out.withColumn("reason", reason).withColumn("scoreable", reason.isNull())


def official_quality(v: DataFrame) -> DataFrame:
    """Median error of the official forecast on clean, fresh hours (50 or more)."""
    clean = (
        (F.col("last_d") > 0) & F.col("first_seen_df").isNotNull() & ~was_placeholder()
        & (F.abs(F.col("last_d") - F.col("first_seen_df")) >= STUB_EPSILON_MW) & (df_capture_lag() <= FRESH_LAG_HOURS)
    )
    rows = v.filter(clean).withColumn("ape", F.abs(F.col("first_seen_df") - F.col("last_d")) / F.col("last_d") * 100)
    n = rows.groupBy("region").agg(F.count("*").alias("n"))
    med = percentiles(rows, ["region"], {"median_ape": (F.col("ape"), 0.5)})
    return n.join(med, "region").withColumn("median_ape", F.when(F.col("n") >= MIN_OFFICIAL_HOURS, F.col("median_ape")))


def newest_vintages(v: DataFrame, n: int) -> DataFrame:
    return newest(v, ["region"], "target_ts", n)


def revision_probe(v: DataFrame, current: DataFrame, epsilon: float = DF_REVISION_EPSILON_MW) -> DataFrame:
    """How often the published day-ahead changed, and what grading it late would do."""
    x = v.filter("first_seen_df IS NOT NULL").join(current.select(*KEYS, "current_df"), list(KEYS)).filter("current_df IS NOT NULL")
    delta = F.abs(F.col("first_seen_df") - F.col("current_df"))
    graded = (F.col("last_d") > 0) & ~was_placeholder() & (F.abs(F.col("last_d") - F.col("first_seen_df")) >= STUB_EPSILON_MW)
    x = x.select(
        "region", delta.alias("delta"), (delta / F.greatest(F.abs("current_df"), F.lit(1.0)) * 100).alias("delta_pct"),
        F.when(graded, F.abs(F.col("first_seen_df") - F.col("last_d")) / F.col("last_d") * 100).alias("issued"),
        F.when(graded, F.abs(F.col("current_df") - F.col("last_d")) / F.col("last_d") * 100).alias("revised"))
    g = x.groupBy("region").agg(
        F.count("*").alias("n_compared"), (F.count_if(F.col("delta") >= epsilon) / F.count("*") * 100).alias("revised_pct"),
        F.coalesce(F.max(F.when(F.col("delta") >= epsilon, F.col("delta_pct"))), F.lit(0.0)).alias("max_revision_pct"), F.count("issued").alias("_n"))
    med = percentiles(x, ["region"], {"as_issued_pct": (F.col("issued"), 0.5), "as_revised_pct": (F.col("revised"), 0.5)})
    return (
        g.join(med, "region").filter((F.col("n_compared") >= MIN_OFFICIAL_HOURS) & (F.col("_n") >= MIN_OFFICIAL_HOURS)).drop("_n")
        .withColumn("median_ape_shift_pts", F.col("as_issued_pct") - F.col("as_revised_pct"))
    )
