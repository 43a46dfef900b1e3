"""Cleaning of hourly series: artifacts, gaps, conditioning, filters, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadstone.operators.quantiles import percentiles
from loadstone.operators.series import CHUNK_ROWS, newest, running, windowed

# Fixed values.
NEAR_ZERO = 0.10
STEP_DROP = 0.40
STEP_LOW = 0.60
DAY_AHEAD = 0.5
HISTORY_HOURS = 24
ARTIFACT_TRAILING = 6
MAX_GAP_HOURS = 6
CONDITIONED_HOURS = 3
CONDITIONED_CLASSES = ("broken",)
LOW_ACTUAL_FRACTION = 0.10


def real_positive(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce((v > 0) & ~F.isnan(v) & (v < float("inf")), F.lit(False))


def implausible(current: Column, median: Column, prev: Column, day_ahead: Column) -> Column:
    """Is a reading an artifact, given its history's median and last real value?"""
    low = current < STEP_LOW * median
    return (
        F.when(~real_positive(current), True)
        .when(median.isNull(), False)
        .when(real_positive(day_ahead) & (current < DAY_AHEAD * day_ahead) & low, True)
        .when(current < NEAR_ZERO * median, True)
        .otherwise(F.coalesce((current < STEP_DROP * prev) & low, F.lit(False)))
    )


def flag_artifacts(df: DataFrame, keys: Sequence[str] = ("region",), order: str = "h", v: str = "demand_mw",
                   day_ahead: str = "forecast_mw", chunk: int = CHUNK_ROWS) -> DataFrame:
    """Every row judged against the 24 raw rows before it."""
    real = F.when(real_positive(v), F.col(v))
    out = windowed(df, keys, order, {
        "_median": lambda w: F.percentile(real, F.lit(0.5)).over(w.rowsBetween(-HISTORY_HOURS, -1)),
        "_prev": lambda w: F.last(real, True).over(w.rowsBetween(-HISTORY_HOURS, -1)),
    }, before=HISTORY_HOURS, chunk=chunk)
    return out.select(*df.columns, implausible(F.col(v), F.col("_median"), F.col("_prev"), F.col(day_ahead)).alias("artifact"))


def _median_of(arr: Column) -> Column:
    s = F.array_sort(arr)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


HIT = "array<struct<ts:timestamp,mw:double,reason:string>>"


def _percent(x: Column) -> Column:
    return F.concat(F.round(x * 100).cast("long").cast("string"), F.lit("%"))


def artifact_log(df: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts", v: str = "demand_mw",
                 day_ahead: str = "forecast_mw", trailing: int = ARTIFACT_TRAILING) -> DataFrame:
    """Exclusions (ts, mw, reason) among the trailing rows of each series.

    An excluded reading is no history for later rows, so the trailing rows are
    folded in order. The folded array holds ``trailing + 24`` rows per series.
    """
    tail = newest(df.select(*keys, ts, v, day_ahead), keys, ts, trailing + HISTORY_HOURS)
    rows = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(v).cast("double").alias("v"), F.col(day_ahead).cast("double").alias("df"))))
    arr = tail.groupBy(*keys).agg(rows.alias("rows"))

    def step(acc, i):
        past = F.filter(F.slice(acc["vals"], F.greatest(i - HISTORY_HOURS, F.lit(0)) + 1, F.least(i, F.lit(HISTORY_HOURS))), real_positive)
        row = F.get(F.col("rows"), i)
        cur, df_mw, med = row["v"], row["df"], _median_of(past)
        prev = F.when(F.size(past) > 0, F.try_element_at(past, F.lit(-1)))
        hit = real_positive(cur) & implausible(cur, med, prev, df_mw)
        reason = (
            F.when(real_positive(df_mw) & (cur < DAY_AHEAD * df_mw),
                   F.concat(_percent(cur / df_mw), F.lit(" of the own day-ahead forecast")))
            .when(cur < NEAR_ZERO * med, F.concat(F.lit("near-zero vs 24h median ("), _percent(cur / med), F.lit(")")))
            .otherwise(F.concat(_percent(1 - cur / prev), F.lit(" single-hour drop to "), _percent(cur / med), F.lit(" of the daily median")))
        )
        entry = F.array(F.struct(row["ts"].alias("ts"), F.round(cur, 2).alias("mw"), reason.alias("reason"))).cast(HIT)
        return F.struct(
            F.transform(acc["vals"], lambda x, j: F.when(~((j == i) & hit), x)).alias("vals"),
            F.when(hit, F.concat(acc["hits"], entry)).otherwise(acc["hits"]).alias("hits"),
        )

    start = F.greatest(F.size("rows") - trailing, F.lit(0))
    folded = F.aggregate(
        F.sequence(start, F.size("rows") - 1),
        F.struct(F.transform("rows", lambda x: x["v"]).alias("vals"), F.array().cast(HIT).alias("hits")),
        step,
        lambda acc: acc["hits"],
    )
    return arr.select(*keys, F.inline(folded)).withColumnRenamed("ts", ts)


def coerce_artifacts(df: DataFrame, log: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts", v: str = "demand_mw") -> DataFrame:
    """The frame with logged readings set to null."""
    hit = log.select(*keys, ts).withColumn("_hit", F.lit(True))
    return df.join(hit, [*keys, ts], "left").withColumn(v, F.when(F.col("_hit").isNull(), F.col(v))).drop("_hit")


def drop_logged(df: DataFrame, log: DataFrame, keys: Sequence[str] = ("region",), ts: str = "ts") -> DataFrame:
    """Rows whose hour is not in the artifact log."""
    return df.join(log.select(*keys, ts), [*keys, ts], "left_anti")


def null_runs(df: DataFrame, keys: Sequence[str], order: str, v: str, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Neighbouring known values of every row and the length of its null run.

    Adds ``_lo``/``_hi`` (order and value of the nearest known rows), ``run_len``
    (0 on known rows) and ``run_pos``.
    """
    known = F.when(F.col(v).isNotNull(), F.struct(F.col(order).alias("h"), F.col(v).alias("v")))
    edges = df.groupBy(*keys).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    out = running(df, keys, order, {"_lo": ("last", known), "_hi": ("next", known)}, chunk).join(edges, list(keys))
    before = F.coalesce(F.col("_lo.h"), F.col("_first") - 1)
    after = F.coalesce(F.col("_hi.h"), F.col("_last") + 1)
    gap = F.col(v).isNull()
    return out.select(
        *df.columns, "_lo", "_hi",
        F.when(gap, after - before - 1).otherwise(0).alias("run_len"),
        F.when(gap, F.col(order) - before).otherwise(0).alias("run_pos"),
    )


def _line(order: str) -> Column:
    """Linear between the neighbours, held after the last known value, else null."""
    lo, hi = F.col("_lo"), F.col("_hi")
    between = lo["v"] + (hi["v"] - lo["v"]) * (F.col(order) - lo["h"]) / (hi["h"] - lo["h"])
    return F.when(hi.isNull(), lo["v"]).when(lo.isNotNull(), between)


def fill_gaps(df: DataFrame, keys: Sequence[str] = ("region",), order: str = "h", v: str = "demand_mw",
              max_gap: int = MAX_GAP_HOURS, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Short null runs interpolated, long ones left, each row labelled."""
    runs = null_runs(df, keys, order, v, chunk)
    short = (F.col("run_len") > 0) & (F.col("run_len") < max_gap)
    quality = F.when(short, "interpolated").when(F.col("run_len") >= max_gap, "gap").otherwise("original")
    value = F.when(short, _line(order)).otherwise(F.col(v))
    return runs.select(*[value.alias(v) if c == v else F.col(c) for c in df.columns], quality.alias("data_quality"))


def interpolate_covariate(df: DataFrame, v: str, keys: Sequence[str] = ("region",), order: str = "h",
                          limit: int = MAX_GAP_HOURS, chunk: int = CHUNK_ROWS) -> DataFrame:
    """At most ``limit`` rows of every null run filled; nothing before the first value."""
    runs = null_runs(df, keys, order, v, chunk)
    value = F.when(F.col(v).isNotNull(), F.col(v)).when(F.col("run_pos") <= limit, _line(order))
    return runs.select(*[value.alias(v) if c == v else F.col(c) for c in df.columns])


def quality_report(df: DataFrame, keys: Sequence[str] = ("region",), winds: Sequence[str] = ("wind_speed_80m",)) -> DataFrame:
    """Rows, nulls per column and out-of-range counts per series, long."""
    checks = {"rows": F.count("*")}
    for c in df.columns:
        if c not in (*keys, "ts"):
            checks[f"null_{c}"] = F.count_if(F.col(c).isNull())
    checks["demand_negative"] = F.count_if(F.col("demand_mw") < 0)
    checks["demand_above_500000"] = F.count_if(F.col("demand_mw") > 500_000)
    checks["temperature_out_of_range"] = F.count_if((F.col("temperature_2m") < -50) | (F.col("temperature_2m") > 150))
    for c in winds:
        checks[f"{c}_negative"] = F.count_if(F.col(c) < 0)
        checks[f"{c}_above_200"] = F.count_if(F.col(c) > 200)
    wide = df.groupBy(*keys).agg(*[c.cast("long").alias(n) for n, c in checks.items()])
    return wide.unpivot(list(keys), list(checks), "check", "n")


def condition_anchor(df: DataFrame, classes: DataFrame, trailing: int = CONDITIONED_HOURS, ts: str = "ts") -> DataFrame:
    """Newest hours of broken-feed series replaced by the day-ahead value."""
    tail = newest(df.select("region", ts), ["region"], ts, trailing).withColumn("_tail", F.lit(True))
    broken = classes.filter(F.col("revision_class").isin(*CONDITIONED_CLASSES)).select("region").distinct().withColumn("_broken", F.lit(True))
    out = df.join(tail, ["region", ts], "left").join(broken, "region", "left")
    swap = F.col("_tail").isNotNull() & F.col("_broken").isNotNull() & real_positive("forecast_mw")
    return out.select(
        *[F.when(swap, F.col("forecast_mw")).otherwise(F.col(c)).alias(c) if c == "demand_mw" else F.col(c) for c in df.columns],
        swap.alias("conditioned"),
        F.when(swap & real_positive("demand_mw"), F.abs(F.col("forecast_mw") - F.col("demand_mw"))).alias("abs_delta_mw"),
    )


def drop_low_actuals(df: DataFrame, keys: Sequence[str], actual: str = "actual", fraction: float = LOW_ACTUAL_FRACTION) -> DataFrame:
    """Rows with at least ``fraction`` of their group's median actual."""
    med = percentiles(df, keys, {"_median": (F.abs(actual), 0.5)})
    return df.join(med, list(keys)).filter(F.abs(actual) >= fraction * F.col("_median")).drop("_median")


def keep_lead(max_lead: int, lead: str = "lead_hours") -> Column:
    """Predicate: lead within the limit; an unknown lead is kept."""
    return F.col(lead).isNull() | (F.col(lead) <= max_lead)


def within_hours(now: Column, window_hours: int, ts: str = "ts") -> Column:
    return F.col(ts) >= now - F.make_dt_interval(F.lit(0), F.lit(window_hours))


def as_of(current: DataFrame, captured: DataFrame, ticks: DataFrame, window_days: int, absent: bool = False,
          ts: str = "ts", v: str = "demand_mw") -> DataFrame:
    """The frame held at each tick: hours captured later are null (or left out).

    ``ticks`` holds a ``tick`` time a row (repeated and null ones count once and not at all).
    Ticks are spread over the days of their fetch window and met by day, so a row meets
    only the ticks whose window holds its day, however many ticks there are.
    """
    first = F.date_sub(F.to_date("tick"), window_days)
    days = ticks.select(F.col("tick").cast("timestamp").alias("tick")).filter("tick IS NOT NULL").distinct().select(
        "tick", F.explode(F.sequence(first, F.to_date("tick"))).alias("_day"))
    seen = current.join(captured.select("region", ts, F.date_trunc("hour", "captured_at").alias("_cap")), ["region", ts], "left")
    out = seen.withColumn("_day", F.to_date(ts)).join(days, "_day").filter(
        F.col(ts) <= F.date_trunc("day", "tick") + F.make_dt_interval(F.lit(0), F.lit(23))).drop("_day")
    late = F.coalesce(F.col("_cap") > F.col("tick"), F.lit(False))
    if absent:
        return out.filter(~late).drop("_cap")
    return out.withColumn(v, F.when(~late, F.col(v))).drop("_cap")


def confidence(status: Column, age_seconds: Column, stale_after: int = 7200) -> Column:
    return (
        F.when(status == "demo", "demo").when(status == "warming", "warming").when(status == "error", "low")
        .when(status == "stale", "medium").when(age_seconds > stale_after, "medium").otherwise("high")
    )
