"""Grid-wide aggregates: fuel mix, flows, correlations, KPIs, national roll-up."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadstone.functions import pricing as pr
from loadstone.functions.text import FUELS, fuel_name
from loadstone.operators.cleaning import implausible
from loadstone.operators.drift import grade
from loadstone.operators.quantiles import percentiles
from loadstone.operators.series import hour_number, keep_one, newest, previous

RENEWABLE = ("wind", "solar", "hydro")
MIN_TEMPERATURE_HOURS = 24 * 14
STRESS_CEILING = 2.0


def fuel_pivot(gen: DataFrame) -> DataFrame:
    """Generation by fuel, wide over the known fuels; null readings left out."""
    x = gen.filter("generation_mw IS NOT NULL").withColumn("fuel", fuel_name("fuel_type"))
    return x.groupBy("region", "ts").pivot("fuel", list(FUELS.values())).agg(F.sum("generation_mw")).na.fill(0.0)


def renewable_share(gen: DataFrame) -> DataFrame:
    """Renewable percent per hour; zero for series without generation or renewables."""
    fuel = fuel_name("fuel_type")
    x = gen.filter("generation_mw IS NOT NULL").groupBy("region", "ts").agg(
        F.sum("generation_mw").alias("total_mw"), F.sum(F.when(fuel.isin(*RENEWABLE), F.col("generation_mw"))).alias("_ren"))
    whole = x.groupBy("region").agg((F.avg("total_mw") > 0).alias("_any"), (F.count("_ren") > 0).alias("_has"))
    pct = F.when(F.col("_any") & F.col("_has"), F.try_divide(F.coalesce("_ren", F.lit(0.0)), F.col("total_mw")) * 100).otherwise(0.0)
    return x.join(whole, "region").select("region", "ts", "total_mw", pct.alias("renewable_pct"))


def fuel_mix(gen: DataFrame, window_hours: int = 24) -> DataFrame:
    """Mean per fuel over the newest day, the largest fuel and its share."""
    span = gen.groupBy("region").agg(F.max("ts").alias("_max"))
    x = gen.join(span, "region").filter(F.col("ts") >= F.col("_max") - F.make_dt_interval(F.lit(0), F.lit(window_hours)))
    per = x.groupBy("region", "ts", fuel_name("fuel_type").alias("fuel")).agg(F.greatest(F.sum("generation_mw"), F.lit(0.0)).alias("mw"))
    hours = per.groupBy("region", "ts").agg(F.sum("mw").alias("total"), F.coalesce(F.sum(F.when(F.col("fuel").isin(*RENEWABLE), F.col("mw"))), F.lit(0.0)).alias("ren"))
    h = hours.groupBy("region").agg(F.count("*").alias("_n"), F.avg("total").alias("avg_total_mw"), F.avg(F.try_divide(F.col("ren"), F.col("total")) * 100).alias("renewable_pct"))
    f = per.groupBy("region", "fuel").agg(F.sum("mw").alias("_s"))
    best = f.groupBy("region").agg(F.max(F.struct(F.col("_s").alias("s"), "fuel")).alias("b"), F.sum("_s").alias("_t"))
    return h.join(best, "region").select(
        "region", "avg_total_mw", F.col("b.fuel").alias("largest_fuel"), (F.col("b.s") / F.col("_n")).alias("largest_mw"),
        (F.try_divide(F.col("b.s"), F.col("_t")) * 100).alias("largest_share_pct"), "renewable_pct")


def net_load(demand: DataFrame, gen: DataFrame) -> DataFrame:
    """Demand less wind and solar on the hours both tables have."""
    fuel = fuel_name("fuel_type")
    g = gen.groupBy("region", "ts").agg(
        F.coalesce(F.sum(F.when(fuel == "wind", F.col("generation_mw"))), F.lit(0.0)).alias("wind"),
        F.coalesce(F.sum(F.when(fuel == "solar", F.col("generation_mw"))), F.lit(0.0)).alias("solar"),
        F.coalesce(F.sum(F.when(fuel.isin(*RENEWABLE), F.col("generation_mw"))), F.lit(0.0)).alias("renewable"), F.sum("generation_mw").alias("total"))
    return demand.join(g, ["region", "ts"]).select(
        "region", "ts", "demand_mw", (F.col("demand_mw") - F.col("wind") - F.col("solar")).alias("net_mw"), "wind", "solar", "renewable", "total")


def net_load_stats(net: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    keys = list(keys)
    d = previous(net.withColumn("_h", hour_number("ts")), keys, "_h", {"_prev": "net_mw"}).withColumn("ramp", F.col("net_mw") - F.col("_prev"))
    evening = F.hour("ts").between(16, 19)
    g = d.groupBy(*keys).agg(
        F.max("ramp").alias("peak_ramp"), F.max(F.when(evening, F.col("ramp"))).alias("evening_ramp"), F.min("net_mw").alias("min_net"), F.max("net_mw").alias("peak_net"),
        F.avg(F.try_divide(F.col("renewable"), F.col("total")) * 100).alias("renewable_pct"), F.max(F.try_divide(F.col("solar"), F.col("total")) * 100).alias("solar_peak_pct"), F.count("*").alias("n"))
    low = net.join(g.select(*keys, "peak_net"), keys).groupBy(*keys).agg(
        F.count_if((F.col("peak_net") > 0) & (F.col("net_mw") < 0.2 * F.col("peak_net"))).alias("curtailment_hours"))
    return g.join(low, keys)


def counterparties(flows: DataFrame, top: int = 3) -> DataFrame:
    """Net flow and the largest counterparties by size at each region's newest hour."""
    # One pass over the flows: the newest hour of every pair, then windows over a region's pairs.
    x = flows.filter("interchange_mw IS NOT NULL").groupBy("from_ba", "to_ba", "ts").agg(F.sum("interchange_mw").alias("mw"))
    pair = x.groupBy("from_ba", "to_ba").agg(F.max(F.struct("ts", "mw")).alias("newest")).select("from_ba", "to_ba", "newest.*")
    region = Window.partitionBy("from_ba")
    at_newest = pair.withColumn("latest_hour", F.max("ts").over(region)).filter("ts = latest_hour")
    ranked = at_newest.select(
        "from_ba", "latest_hour", F.round(F.sum("mw").over(region), 2).alias("net_mw"),
        F.row_number().over(region.orderBy(F.desc(F.abs("mw")), "to_ba")).alias("rank"), "to_ba", F.round("mw", 2).alias("mw"))
    return ranked.filter(F.col("rank") <= top)


def temperature_percentiles(weather: DataFrame, now: Column, min_hours: int = MIN_TEMPERATURE_HOURS) -> DataFrame:
    x = weather.filter((F.col("ts") <= now) & F.col("temperature_2m").isNotNull())
    q = percentiles(x, ["region"], {"p90": (F.col("temperature_2m"), 0.90), "p95": (F.col("temperature_2m"), 0.95), "p99": (F.col("temperature_2m"), 0.99)})
    n = x.groupBy("region").agg(F.count("*").alias("n_hours")).filter(F.col("n_hours") >= min_hours)
    return n.join(q, "region").select("region", *[F.round(c, 1).alias(c) for c in ("p90", "p95", "p99")], "n_hours", F.bround(F.col("n_hours") / 24).cast("long").alias("window_days"))


def correlations(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("region",)) -> DataFrame:
    """Pairwise Pearson correlations in one aggregate, long; nulls dropped per pair."""
    keys, pairs = list(keys), list(combinations(cols, 2))
    g = df.groupBy(*keys).agg(*[F.corr(*_both(a, b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return g.select(*keys, F.inline(rows))


def _both(a: str, b: str) -> tuple[Column, Column]:
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(ok, F.col(a)), F.when(ok, F.col(b))


def importance(corr: DataFrame, target: str, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Absolute correlation with the target, ascending rank."""
    other = F.when(F.col("a") == target, F.col("b")).when(F.col("b") == target, F.col("a"))
    x = corr.select(*keys, other.alias("feature"), F.abs("r").alias("importance")).filter("feature IS NOT NULL")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("importance", "feature")))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, ts: str, value: str, tolerance: int, strict: bool = False) -> DataFrame:
    """Value of the right row nearest in time to each left row, within a tolerance.

    Left rows go to the three buckets their tolerance touches and meet right rows
    by equality; the earlier row wins a tie.
    """
    keys = list(keys)
    b = F.floor(F.unix_timestamp(at) / tolerance)
    l = left.select(*keys, at, F.explode(F.sequence(b - 1, b + 1)).alias("_b")).distinct()
    r = right.filter(F.col(value).isNotNull()).select(*keys, F.col(ts).alias("_rt"), F.col(value).alias("_rv"), F.floor(F.unix_timestamp(ts) / tolerance).alias("_b"))
    gap = F.abs(F.unix_micros("_rt") - F.unix_micros(at))
    limit = gap < tolerance * 1_000_000 if strict else gap <= tolerance * 1_000_000
    best = l.join(r, [*keys, "_b"]).filter(limit).groupBy(*keys, at).agg(F.min_by(F.struct("_rt", "_rv"), F.struct(gap, "_rt")).alias("m"))
    return left.join(best, [*keys, at], "left").select(*left.columns, F.col("m._rt").alias("matched_ts"), F.col("m._rv").alias(f"nearest_{value}"))


def tail_join(a: DataFrame, b: DataFrame, keys: Sequence[str], n: int, ts: str = "ts") -> DataFrame:
    """Newest rows of two tables aligned by their distance from the end."""
    x = newest(a, keys, ts, n, "_k")
    y = newest(b, keys, ts, n, "_k").drop(ts)
    return x.join(y, [*keys, "_k"]).drop("_k")


def kpis(demand: DataFrame) -> DataFrame:
    """Now, seven-day peak, low and mean, and the change to a day earlier."""
    real = demand.filter("demand_mw > 0")
    week = newest(real, ["region"], "ts", 168)
    g = week.groupBy("region").agg(
        F.max("ts").alias("now_ts"), F.max_by("demand_mw", "ts").alias("now_mw"), F.max("demand_mw").alias("peak_7d"), F.min("demand_mw").alias("low_7d"), F.avg("demand_mw").alias("avg_7d"))
    g = g.withColumn("_at", F.col("now_ts") - F.expr("INTERVAL 24 HOURS"))
    n = nearest(g, real, ["region"], "_at", "ts", "demand_mw", 90 * 60)
    return n.select("region", "now_ts", "now_mw", "peak_7d", "low_7d", "avg_7d", F.col("matched_ts").alias("anchor_ts"),
                    ((F.col("now_mw") - F.col("nearest_demand_mw")) / F.col("nearest_demand_mw") * 100).alias("trend_pct"))


def region_state(demand: DataFrame, hours: int = 24) -> DataFrame:
    """Latest and previous real reading, and whether the latest is plausible.

    A region contributes its newest ``hours`` rows, a bounded group.
    """
    real = demand.filter("demand_mw > 0")
    top = newest(real, ["region"], "ts", hours, "_k")
    s = top.groupBy("region").agg(
        F.max(F.when(F.col("_k") == 1, F.col("demand_mw"))).alias("current_mw"), F.max(F.when(F.col("_k") == 2, F.col("demand_mw"))).alias("prev_mw"),
        F.percentile("demand_mw", F.lit(0.5)).alias("median_mw"))
    return s.withColumn("artifact", implausible(F.col("current_mw"), F.col("median_mw"), F.col("prev_mw"), F.lit(None).cast("double")))


def simultaneous_peak(demand: DataFrame, keys: Sequence[str] = (), n: int = 24) -> DataFrame:
    """Largest sum over regions at one distance from the newest row."""
    top = newest(demand, ["region"], "ts", n, "_k")
    sums = top.groupBy(*keys, "_k").agg(F.coalesce(F.sum(F.when(F.col("demand_mw") > 0, F.col("demand_mw"))), F.lit(0.0)).alias("s"))
    return sums.groupBy(*keys).agg(F.max("s").alias("simultaneous_peak_mw"))


def national_summary(demand: DataFrame, capacity: DataFrame, ceiling: float = STRESS_CEILING) -> DataFrame:
    """Total, peak, utilisation and top stress over plausible regions, one row."""
    state = region_state(demand)
    ok = state.filter("NOT artifact")
    j = ok.join(capacity.select("region", "capacity_mw", "unreliable"), "region", "left")
    ratio = F.try_divide(F.col("current_mw"), F.col("capacity_mw"))
    rel = F.coalesce((F.col("capacity_mw") > 0) & ~F.col("unreliable") & (ratio <= ceiling), F.lit(False))
    out = j.agg(
        F.count("*").alias("reporting_regions"), F.sum("current_mw").alias("total_mw"),
        (F.try_divide(F.sum(F.when(rel, F.col("current_mw"))), F.sum(F.when(rel, F.col("capacity_mw")))) * 100).alias("utilization_pct"),
        F.max(F.when(rel, F.struct(ratio.alias("r"), "region"))).alias("_top"))
    peak = simultaneous_peak(demand.join(ok.select("region"), "region", "left_semi"))
    gone = state.agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("artifact"), F.col("region")))), ","))
    return out.select(
        "reporting_regions", "total_mw", peak.scalar().alias("simultaneous_peak_mw"), "utilization_pct", F.col("_top.region").alias("top_region"),
        (F.least(F.col("_top.r"), F.lit(1.0)) * 100).alias("top_stress_pct"), gone.scalar().alias("artifact_excluded"))


def group_rollup(demand: DataFrame, capacity: DataFrame) -> DataFrame:
    """Current load and utilisation by region, group and in all."""
    j = region_state(demand).join(capacity, "region")
    return j.rollup("grid", "region").agg(
        F.grouping_id().alias("level"), F.sum("current_mw").alias("current_mw"), F.sum("capacity_mw").alias("capacity_mw"),
        (F.try_divide(F.sum("current_mw"), F.sum("capacity_mw")) * 100).alias("utilization_pct"))


def card_order(state: DataFrame, capacity: DataFrame) -> DataFrame:
    """Regions in the order of the demand, stress and change sorts; unusable ones last."""
    j = state.join(capacity.select("region", "capacity_mw", "unreliable"), "region", "left")
    cur, cap = F.coalesce("current_mw", F.lit(0.0)), F.col("capacity_mw")
    stress = F.when((cap > 0) & (cur > 0) & ~F.col("unreliable"), -(cur / cap)).otherwise(1.0)
    change = F.when((F.col("prev_mw") > 0) & (cur > 0), -F.abs((cur - F.col("prev_mw")) / F.col("prev_mw"))).otherwise(0.0)
    sorts = F.array(*[F.struct(F.lit(n).alias("sort"), c.alias("value")) for n, c in (("demand", -cur), ("stress", stress), ("change", change))])
    return j.select("region", F.inline(sorts)).orderBy("sort", F.asc_nulls_last("value"), "region")


def phase_rollup(results: DataFrame) -> DataFrame:
    """Per phase total, maximum, slowest region and count, largest total first."""
    x = results.select("region", F.explode("timings").alias("phase", "secs"))
    return x.groupBy("phase").agg(
        F.sum("secs").alias("total_s"), F.max("secs").alias("max_s"), F.max_by("region", F.struct("secs", "region")).alias("slowest_region"), F.count("*").alias("n")).orderBy(F.desc("total_s"))


def outlier_count(demand: DataFrame, n: int = 24, factor: float = 2.5, min_rows: int = 6) -> DataFrame:
    """Readings of the newest rows further than ``factor`` deviations from their mean."""
    top = newest(demand, ["region"], "ts", n).filter("demand_mw IS NOT NULL")
    s = top.groupBy("region").agg(F.avg("demand_mw").alias("_m"), F.stddev_samp("demand_mw").alias("_sd"), F.count("*").alias("n")).filter(F.col("n") >= min_rows)
    sd = F.when(F.coalesce("_sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_sd"))
    return top.join(s, "region").groupBy("region", "n").agg(F.count_if(F.abs(F.col("demand_mw") - F.col("_m")) > factor * sd).alias("outliers"))


def temperature_regime(weather: DataFrame, n: int = 24) -> DataFrame:
    t = newest(weather, ["region"], "ts", n).groupBy("region").agg(F.max("temperature_2m").alias("t_max"), F.min("temperature_2m").alias("t_min"))
    label = F.when(F.col("t_max") >= 90, "heat").when(F.col("t_min") <= 30, "cold").when(F.col("t_max") >= 80, "warm").when(F.col("t_min") <= 40, "cool").otherwise("comfortable")
    return t.withColumn("regime", label)


def stress_table(state: DataFrame, capacity: DataFrame) -> DataFrame:
    j = state.join(capacity.select("region", "capacity_mw", "unreliable"), "region")
    a = ("current_mw", "capacity_mw", "unreliable")
    return j.select("region", "current_mw", "capacity_mw", pr.utilization_pct(*a[:2]).alias("utilization_pct"), pr.headroom_pct(*a[:2]).alias("headroom_pct"),
                    pr.price(*a[:2]).alias("price"), pr.stress_score(*a).alias("stress_score"), pr.stress_label(*a).alias("stress_label"))


def alerts_for_regions(alerts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Alerts of every region's states, one row per region and alert id.

    ``bridge`` (region, state, state_no) lists a region's states in order; the
    first state that reports an alert wins.
    """
    j = alerts.join(bridge, "state")
    once = keep_one(j, ["region", "id"], F.col("state_no"), F.col("arrival"))
    return once.withColumn("severity_rank", F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3))


def live_alerts(alerts: DataFrame, now: Column) -> DataFrame:
    """Alerts without an expiry or with a later one."""
    return alerts.filter(F.col("expires").isNull() | (F.col("expires") > now))


def alert_cards(live: DataFrame, cap: int = 20) -> DataFrame:
    """The capped card list, most severe first; counts are taken from all live alerts."""
    w = Window.partitionBy("region").orderBy("severity_rank", "state_no", "arrival")
    return live.withColumn("card", F.row_number().over(w)).filter(F.col("card") <= cap)


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Rank of each model by MAPE within its region, best flagged, graded at seven days."""
    w = Window.partitionBy("region").orderBy(F.asc_nulls_last("mape"), "model")
    return metrics.select("*", F.row_number().over(w).alias("rank"), (F.row_number().over(w) == 1).alias("best"), grade(F.col("mape"), "7d").alias("grade"))


def resolve_error(df: DataFrame, min_n: int = 24) -> DataFrame:
    """First available displayed error and the label of its source."""
    def finite(c):
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    live7, live30 = F.coalesce("smape_7d", "mape_7d"), F.coalesce("smape_30d", "mape_30d")
    ok7 = (F.col("n_7d") >= min_n) & live7.isNotNull() & ~F.isnan(live7)
    ok30 = (F.col("n_30d") >= min_n) & live30.isNotNull() & ~F.isnan(live30)
    hold = F.when(finite("holdout_ensemble"), F.col("holdout_ensemble")).when(finite("holdout_trees"), F.col("holdout_trees"))
    hold = F.when(hold > 0, hold)
    return df.select(
        "region", F.when(ok7, live7).when(ok30, live30).otherwise(hold).alias("error"),
        F.when(ok7, F.when(F.col("smape_7d").isNotNull(), "live 7d sMAPE").otherwise("live 7d MAPE"))
        .when(ok30, F.when(F.col("smape_30d").isNotNull(), "live 30d sMAPE").otherwise("live 30d MAPE")).when(hold.isNotNull(), "holdout MAPE").otherwise("").alias("source"))
