"""Two-arm benchmark against the official day-ahead forecast, with drop accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadstone.operators import metrics as mt
from loadstone.operators import vintage as vt
from loadstone.operators.quantiles import percentiles, ranked
from loadstone.operators.series import newest

# Fixed values.
DROP_REASONS = ["no_df", "stale_capture", "unsettled", "unresolved_stub", "first_seen_placeholder", "no_prediction"]
ARMS = ["official", "official_revised", "ours"]
DOCUMENTED_LEAD_MAX = 41.0
MIN_SCOREABLE = 40
GAP_WARN_HOURS = 120.0


def pair_hours(v: DataFrame, predictions: DataFrame, extra: Sequence[str] = (), exclude_stale: bool = True) -> DataFrame:
    """Vintage hours joined with our prediction and the revised official value.

    Every hour keeps its row: ``drop_reason`` is the first rule it trips, null on
    usable pairs. ``predictions`` holds region, target_ts, predicted, revised_df
    and the ``extra`` key columns.
    """
    df, actual = F.col("first_seen_df"), F.col("last_d")
    j = v.join(predictions, list(vt.KEYS), "left")
    rules = F.when(df.isNull(), "no_df")
    if exclude_stale:
        rules = rules.when(vt.df_capture_lag() > vt.FRESH_LAG_HOURS, "stale_capture")
    reason = (
        rules.when(actual.isNull() | (actual <= 0), "unsettled")
        .when(F.abs(actual - df) < vt.STUB_EPSILON_MW, "unresolved_stub")
        .when(vt.was_placeholder(), "first_seen_placeholder")
        .when(F.col("predicted").isNull(), "no_prediction")
    )
    return j.select(
        *vt.KEYS, *extra, actual.alias("actual"), df.alias("official"),
        F.coalesce("revised_df", df).alias("official_revised"), F.col("predicted").alias("ours"), reason.alias("drop_reason"))


def drop_counts(pairs: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.count_if(F.col("drop_reason").isNull()).alias("paired"),
        *[F.count_if(F.col("drop_reason") == r).alias(r) for r in DROP_REASONS])


def arms_long(pairs: DataFrame, keys: Sequence[str], arms: Sequence[str] = ARMS) -> DataFrame:
    """Usable pairs, one row per arm."""
    return pairs.filter("drop_reason IS NULL").unpivot([*keys, "actual"], list(arms), "arm", "predicted")


def arm_scores(pairs: DataFrame, keys: Sequence[str], arms: Sequence[str] = ARMS) -> DataFrame:
    return mt.scorecard(arms_long(pairs, keys, arms), [*keys, "arm"])


def lead_payload(pairs: DataFrame, observed_lead: DataFrame | None = None, min_hours: int = vt.MIN_PAIRED_HOURS) -> DataFrame:
    """One row per region and lead: scores of both arms, deltas, winners, verdict."""
    keys = ["region", "lead"]
    s = arm_scores(pairs, keys)
    wide = s.groupBy(*keys).pivot("arm", ARMS).agg(F.max("mape").alias("mape"), F.max("wape").alias("wape"), F.max("median_ape").alias("median_ape"))
    n = pairs.groupBy(*keys).agg(F.count_if(F.col("drop_reason").isNull()).alias("n")).filter("lead IS NOT NULL")
    out = n.join(wide, keys, "left")
    if observed_lead is not None:
        out = out.join(observed_lead, keys, "left")
    else:
        out = out.withColumn("observed_lead_h", F.lit(None).cast("double"))
    ok = F.col("n") >= min_hours
    off, rev, our = F.col("official_mape"), F.col("official_revised_mape"), F.col("ours_mape")
    return out.select(
        *keys, "n", ok.alias("scoreable"),
        *[F.when(ok, F.col(f"{a}_{m}")).alias(f"{a}_{m}") for a in ARMS for m in ("mape", "wape", "median_ape")],
        F.when(ok, off - our).alias("delta_mape"),
        F.when(ok, F.col("official_wape") - F.col("ours_wape")).alias("delta_wape"),
        F.when(ok, F.col("official_median_ape") - F.col("ours_median_ape")).alias("delta_median_ape"),
        F.when(ok, rev - our).alias("delta_mape_vs_revised"),
        F.when(ok, F.when(our < off, "ours").otherwise("official")).alias("winner"),
        F.when(ok, F.when(our < rev, "ours").otherwise("official")).alias("winner_vs_revised"),
        F.when(ok, F.when(F.col("observed_lead_h").isNotNull(), "observed").otherwise("nominal")).alias("lead_basis"),
        F.when(ok & (F.col("lead") == "48h"), F.coalesce(F.col("observed_lead_h") > DOCUMENTED_LEAD_MAX, F.lit(False))).alias("conservative"),
    )


def stale_impact(v: DataFrame, predictions: DataFrame, min_hours: int = vt.MIN_PAIRED_HOURS) -> DataFrame:
    """Shift of both arms when the stale-capture rule is lifted.

    Both populations come from one pairing: an hour is copied to the filtered arm
    only if it is fresh.
    """
    every = pair_hours(v, predictions, ["lead"], exclude_stale=False).filter("drop_reason IS NULL")
    lag = v.select(*vt.KEYS, (vt.df_capture_lag() <= vt.FRESH_LAG_HOURS).alias("fresh"))
    x = every.join(lag, list(vt.KEYS)).select("region", "lead", "fresh", mt.ape("actual", "ours").alias("o"), mt.ape("actual", "official").alias("f"))
    g = x.groupBy("region", "lead").agg(
        F.count("*").alias("n_all"), F.count_if("fresh").alias("n_fresh"),
        (F.avg("o") - F.avg(F.when(F.col("fresh"), F.col("o")))).alias("ours_shift"),
        (F.avg("f") - F.avg(F.when(F.col("fresh"), F.col("f")))).alias("official_shift"))
    return g.filter((F.col("n_all") > F.col("n_fresh")) & (F.col("n_all") >= min_hours)).select(
        "region", "lead", (F.col("n_all") - F.col("n_fresh")).alias("n_hours_excluded"),
        F.col("ours_shift").alias("ours_mape_shift_pts"), F.col("official_shift").alias("official_mape_shift_pts"))


def fleet_rollup(payload: DataFrame, isolate: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Counts, wins, medians and spreads over the scoreable regions, one row a region and key."""
    apart = F.col("region").isin(list(isolate)) if isolate else F.lit(False)
    inside = F.col("scoreable") & ~apart
    win = F.col("winner") == "ours"
    base = payload.groupBy(*keys).agg(
        F.count_if("scoreable").alias("n_scoreable"), F.count_if(~F.col("scoreable")).alias("n_excluded"), F.count_if(inside).alias("n"),
        F.count_if(inside & win).alias("wins"), F.count_if(inside & ~win).alias("losses"),
        *[e for a in ("ours", "official") for e in (
            F.min(F.when(inside, F.col(f"{a}_mape"))).alias(f"{a}_min"), F.max(F.when(inside, F.col(f"{a}_mape"))).alias(f"{a}_max"))],
        *[F.percentile(F.when(inside, F.col(f"{a}_mape")), F.lit(0.5)).alias(f"median_{a}_mape") for a in ("ours", "official")],
        F.count_if(F.col("scoreable") & apart).alias("n_isolated"))
    return base.select(
        "*", F.when(F.col("ours_min") > 0, F.col("ours_max") / F.col("ours_min")).alias("ours_ratio"),
        F.when(F.col("official_min") > 0, F.col("official_max") / F.col("official_min")).alias("official_ratio"))


def scoreability_alerts(score: DataFrame, floor: int = MIN_SCOREABLE, warn: float = GAP_WARN_HOURS) -> DataFrame:
    """Fleet count under its floor, and scored regions whose gap nears the gate."""
    fleet = score.agg(F.count_if("scoreable").alias("n")).filter(F.col("n") < floor).select(
        F.lit("scoreability_drop").alias("event"), F.lit(None).cast("string").alias("region"), F.col("n").cast("double").alias("value"))
    risk = score.filter(F.col("scoreable") & (F.col("longest_gap_hours") >= warn)).select(
        F.lit("gap_at_risk").alias("event"), "region", F.col("longest_gap_hours").alias("value"))
    return fleet.unionByName(risk)


def metric_robustness(payload: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Does the fleet winner change when scored on another statistic?"""
    names = ["mape", "median_ape", "wape"]
    rows = payload.filter("scoreable")
    arms = ("ours", "official")
    med = rows.groupBy(*keys).agg(
        *[F.percentile(f"{a}_{m}", F.lit(0.5)).alias(f"{a}_{m}") for a in arms for m in names],
        *[F.try_divide(F.max(f"{a}_mape"), F.min(f"{a}_mape")).alias(f"{a}_spread") for a in arms])
    lead = F.col("ours_mape") < F.col("official_mape")
    verdicts = F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"ours_{m}").alias("ours"), F.col(f"official_{m}").alias("official"),
        F.when(F.col(f"ours_{m}") == F.col(f"official_{m}"), "tie")
        .when((F.col(f"ours_{m}") < F.col(f"official_{m}")) == lead, "same").otherwise("flips").alias("verdict")) for m in names])
    return med.select(*keys, "ours_spread", "official_spread", F.inline(verdicts))


def drop_audit(v: DataFrame, trailing: int = 48, min_hours: int = vt.MIN_PAIRED_HOURS) -> DataFrame:
    """Why hours drop per region, the shortfall, and usable hours at the edge."""
    none = F.lit(None).cast("double")
    pairs = pair_hours(v, v.select(*vt.KEYS, none.alias("predicted"), none.alias("revised_df")))
    counts = drop_counts(pairs).drop("paired").withColumnRenamed("no_prediction", "would_pair")
    usable = ~vt.was_placeholder() & (vt.df_capture_lag() <= vt.FRESH_LAG_HOURS)
    edge = newest(v, ["region"], "target_ts", trailing).groupBy("region").agg(F.count_if(usable).alias("edge_usable"))
    return counts.join(edge, "region").withColumn("short_by", F.greatest(F.lit(0), min_hours - F.col("would_pair")))


def error_attribution(rows: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Share of each series' absolute error by hour, ramp quartile, temperature
    quintile, weekend and holiday: one row per cut and bucket.

    ``rows`` holds keys, ts, actual, predicted, ramp, temperature and is_holiday.
    Quartiles and quintiles are cut on ranks, earlier hours first on ties.
    """
    keys, on = list(keys), [*keys, "ts"]
    x = rows
    for col, bins, name in (("ramp", 4, "_r"), ("temperature", 5, "_t")):
        rank = ranked(rows.select(*on, col), keys, col, ["ts"])
        edge = sum((F.when(F.col("rank") > 1 + (F.col("rank_of") - 1) * k / bins, 1).otherwise(0) for k in range(1, bins)), F.lit(1))
        x = x.join(rank.select(*on, edge.alias(name)), on, "left")
    err = F.abs(F.col("actual") - F.col("predicted"))
    cuts = F.array(*[F.struct(F.lit(n).alias("cut"), c.cast("string").alias("bucket")) for n, c in (
        ("hour", F.hour("ts")), ("ramp_quartile", F.col("_r")), ("temp_quintile", F.col("_t")), ("weekend", F.weekday("ts") >= 5), ("holiday", F.col("is_holiday") > 0))])
    total = rows.groupBy(*keys).agg(F.sum(err).alias("_total"))
    g = x.select(*keys, err.alias("_err"), F.inline(cuts)).filter("bucket IS NOT NULL").groupBy(*keys, "cut", "bucket").agg(
        F.sum("_err").alias("abs_error"), F.count("*").alias("n"))
    return g.join(total, keys).select(*keys, "cut", "bucket", "n", "abs_error", (F.try_divide(F.col("abs_error"), F.col("_total")) * 100).alias("share_pct"))


def miss_matrix(rows: DataFrame, keys: Sequence[str] = ("region",), threshold: float = 5.0) -> DataFrame:
    """Hours both arms missed, only one missed, or neither, with our error share."""
    keys = list(keys)
    a, b = mt.ape("actual", "ours") > threshold, mt.ape("actual", "official") > threshold
    cell = F.when(a & b, "both").when(a, "ours_only").when(b, "theirs_only").otherwise("neither")
    our, their = F.abs(F.col("actual") - F.col("ours")), F.abs(F.col("actual") - F.col("official"))
    g = rows.groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(our).alias("_e"), F.avg(our).alias("our_mean_err"), F.avg(their).alias("official_mean_err"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("_e").alias("_t"))
    return g.join(t, keys).select(*keys, "cell", "n", (F.col("n") / F.col("_n") * 100).alias("hours_pct"), (F.try_divide(F.col("_e"), F.col("_t")) * 100).alias("share_pct"), "our_mean_err", "official_mean_err")


# Fixed values.
WIN_RATE_GATE = 0.60
MEAN_MARGIN_GATE_PCT = 2.0
NEVER_CONDITIONED = ("clean", "unknown")


def anchor_proxy(v: DataFrame, classes: DataFrame) -> DataFrame:
    """Would the day-ahead value have been a better anchor than the first reading?

    Fresh hours by revision class; placeholders tie and are counted apart.
    """
    fresh = v.filter((vt.capture_lag() <= vt.FRESH_LAG_HOURS) & (F.col("last_d") > 0) & F.col("first_seen_df").isNotNull())
    x = fresh.join(classes.select("region", "revision_class"), "region").select(
        "revision_class", vt.was_placeholder().alias("tie"),
        *[F.when(~vt.was_placeholder(), F.abs(F.col(c) - F.col("last_d")) / F.col("last_d") * 100).alias(n)
          for n, c in (("prod", "first_seen_d"), ("df", "first_seen_df"))])
    g = x.groupBy("revision_class").agg(
        F.count("prod").alias("n_contested"), F.count_if("tie").alias("placeholder_ties"), F.avg("prod").alias("prod_mean"), F.avg("df").alias("df_mean"),
        F.try_divide(F.count_if(F.col("df") < F.col("prod")), F.count("prod")).alias("win_rate"), (F.avg("prod") - F.avg("df")).alias("margin"))
    med = percentiles(x, ["revision_class"], {"prod_median": (F.col("prod"), 0.5), "df_median": (F.col("df"), 0.5)})
    passes = (F.col("win_rate") > WIN_RATE_GATE) & (F.col("margin") >= MEAN_MARGIN_GATE_PCT)
    verdict = (
        F.when(F.col("revision_class").isin(*NEVER_CONDITIONED), "never")
        .when(passes, F.when(F.col("revision_class") == "bulk", "review").otherwise("condition")).otherwise("skip"))
    return g.join(med, "revision_class", "left").withColumn("verdict", verdict)
