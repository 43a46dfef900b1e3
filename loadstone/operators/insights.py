"""Statistics and rule tables behind the written insights, and snapshot diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadstone.functions.text import pct_change
from loadstone.operators import metrics as mt
from loadstone.operators.drift import grade
from loadstone.operators.grid import nearest, tail_join
from loadstone.operators.series import newest

# Fixed values.
RELEVANCE = {
    "peak_demand": ["grid_ops", "trader", "renewables", "data_scientist"], "ramp_rate": ["grid_ops", "trader"], "weekday_weekend_ratio": ["data_scientist", "trader"],
    "hours_above_p90": ["grid_ops", "trader", "renewables"], "temp_correlation": ["renewables", "data_scientist"], "wow_trend": ["trader", "grid_ops"],
    "demand_cv": ["data_scientist", "grid_ops"],
}
CHANGE_RELEVANCE = {
    "demand": ["grid_ops", "trader"], "forecast": ["grid_ops", "trader", "renewables"], "alerts": ["grid_ops"], "generation": ["renewables", "grid_ops"],
    "models": ["data_scientist", "trader"], "data": ["grid_ops", "renewables", "trader", "data_scientist"],
}
MAX_INSIGHTS = {"grid_ops": 4, "renewables": 4, "trader": 4, "data_scientist": 5}
SEVERITY_RANK = {"warning": 0, "notable": 1, "info": 2}
MAX_CHANGES = 5


def _rules(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    """(rule, applies, severity, value) columns to one row per applying rule."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(on, F.lit(False)).alias("on"), sev.alias("severity"), v.cast("double").alias("value")) for n, on, sev, v in rules])
    return df.select(*keys, F.inline(rows)).filter("on").drop("on")


def historical_stats(demand: DataFrame, weather: DataFrame, rows: int) -> DataFrame:
    """Statistics of the newest ``rows`` hours of each series (a bounded group)."""
    k = ["region"]
    x = newest(demand.filter("demand_mw IS NOT NULL"), k, "ts", rows, "_k")
    w = newest(weather, k, "ts", rows).select("region", "ts", "temperature_2m")
    g = x.groupBy("region").agg(
        F.count("*").alias("n"), F.max("demand_mw").alias("peak_mw"), F.min("demand_mw").alias("min_mw"), F.avg("demand_mw").alias("avg_mw"),
        F.coalesce(F.stddev_samp("demand_mw"), F.lit(0.0)).alias("std_mw"), F.max_by("ts", F.struct("demand_mw", "_k")).alias("peak_time"),
        F.avg(F.when(F.weekday("ts") < 5, F.col("demand_mw"))).alias("weekday_avg"), F.avg(F.when(F.weekday("ts") >= 5, F.col("demand_mw"))).alias("weekend_avg"),
        F.avg(F.when(F.col("_k") <= 168, F.col("demand_mw"))).alias("_this"), F.avg(F.when(F.col("_k").between(169, 336), F.col("demand_mw"))).alias("_last"),
        F.percentile("demand_mw", F.lit(0.9)).alias("p90"))
    morning = x.filter(F.hour("ts").between(6, 10))
    step = F.col("demand_mw") - F.lag("demand_mw", 1).over(Window.partitionBy("region").orderBy("ts"))
    ramp = morning.withColumn("_d", step).groupBy("region").agg(F.max("_d").alias("morning_ramp"))
    above = x.join(g.select("region", "p90"), "region").groupBy("region").agg(F.count_if(F.col("demand_mw") > F.col("p90")).alias("hours_above_p90"))
    both = tail_join(x.drop("_k"), w, k, rows)
    corr = both.filter("temperature_2m IS NOT NULL").groupBy("region").agg(F.when(F.count("*") > 10, F.corr("demand_mw", "temperature_2m")).alias("temp_corr"))
    at_peak = nearest(g.select("region", "peak_time"), w, k, "peak_time", "ts", "temperature_2m", 2 * 3600, strict=True).select(
        "region", F.col("nearest_temperature_2m").alias("temp_at_peak"))
    out = g.join(ramp, k, "left").join(above, k).join(corr, k, "left").join(at_peak, k, "left")
    return out.select(
        "region", "n", "peak_mw", "min_mw", "avg_mw", "std_mw", "peak_time", F.when(F.col("avg_mw") > 0, (F.col("peak_mw") - F.col("avg_mw")) / F.col("avg_mw") * 100).alias("pct_above_avg"),
        "weekday_avg", "weekend_avg", F.when(F.col("n") >= 24, F.col("morning_ramp")).alias("morning_ramp"),
        F.when((F.col("n") >= 336) & (F.col("_last") > 0), (F.col("_this") - F.col("_last")) / F.col("_last") * 100).alias("wow_pct"), "hours_above_p90", "temp_corr", "temp_at_peak")


def historical_rules(s: DataFrame, rows: int) -> DataFrame:
    ratio = F.when(F.col("weekday_avg") > 0, (F.col("weekday_avg") - F.col("weekend_avg")) / F.col("weekday_avg") * 100)
    r, wow = F.abs("temp_corr"), F.abs("wow_pct")
    cv = F.when(F.col("avg_mw") > 0, F.col("std_mw") / F.col("avg_mw") * 100)
    info = F.lit("info")
    return _rules(s, ["region"], [
        ("peak_demand", F.col("peak_mw") != 0, info, F.col("peak_mw")),
        ("ramp_rate", F.col("morning_ramp") > 0, info, F.col("morning_ramp")),
        ("weekday_weekend_ratio", F.abs(ratio) > 3, info, ratio),
        ("hours_above_p90", F.col("hours_above_p90") > rows * 0.15, F.lit("notable"), F.col("hours_above_p90")),
        ("temp_correlation", r > 0.4, F.when(r < 0.7, "info").otherwise("notable"), F.col("temp_corr")),
        ("wow_trend", wow > 1.5, F.when(wow > 5, "notable").otherwise("info"), F.col("wow_pct")),
        ("demand_cv", cv > 10, info, cv),
    ])


def persona_insights(insights: DataFrame, keys: Sequence[str] = ("region",), relevance: dict = RELEVANCE) -> DataFrame:
    """Insights per persona: by the persona's place in the rule's list, then severity, capped.

    A rule appears at most once per key, so a group holds as many rows as rules.
    """
    who = F.create_map(*[x for rule, ps in relevance.items() for x in (F.lit(rule), F.array(*[F.lit(p) for p in ps]))])
    sev = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    cap = F.create_map(*[F.lit(x) for kv in MAX_INSIGHTS.items() for x in kv])
    order = F.create_map(*[F.lit(x) for i, rule in enumerate(relevance) for x in (rule, i)])
    x = insights.select("*", F.posexplode(who[F.col("rule")]).alias("place", "persona"))
    w = Window.partitionBy(*keys, "persona").orderBy("place", F.coalesce(sev[F.col("severity")], F.lit(2)), order[F.col("rule")])
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap[F.col("persona")]).drop("place")


def forecast_stats(forecast: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Peak, trough, range, ramps and weekday split of one forecast per key.

    A forecast has at most its horizon of rows.
    """
    keys = list(keys)
    step = F.col("predicted") - F.lag("predicted", 1).over(Window.partitionBy(*keys).orderBy("ts"))
    x = forecast.withColumn("_d", step)
    first = -F.unix_timestamp("ts")
    return x.groupBy(*keys).agg(
        F.max("predicted").alias("peak_mw"), F.min("predicted").alias("min_mw"), F.avg("predicted").alias("avg_mw"), (F.max("predicted") - F.min("predicted")).alias("range_mw"),
        F.max_by("ts", F.struct("predicted", first)).alias("peak_time"), F.min_by("ts", F.struct("predicted", "ts")).alias("min_time"),
        F.max("_d").alias("max_ramp"), F.max_by("ts", F.when(F.col("_d").isNotNull(), F.struct("_d", first))).alias("max_ramp_time"), F.min("_d").alias("max_drop"),
        F.avg(F.when(F.weekday("ts") < 5, F.col("predicted"))).alias("weekday_avg"), F.avg(F.when(F.weekday("ts") >= 5, F.col("predicted"))).alias("weekend_avg"),
        F.count("*").alias("horizon")).withColumn("peak_day", F.date_format("peak_time", "EEEE"))


def forecast_rules(s: DataFrame, capacity: DataFrame) -> DataFrame:
    j = s.join(capacity.select("region", "capacity_mw"), "region", "left").withColumn("capacity_mw", F.coalesce("capacity_mw", F.lit(50000.0)))
    use = F.when(F.col("capacity_mw") > 0, F.col("peak_mw") / F.col("capacity_mw") * 100)
    diff = F.when(F.col("weekday_avg") > 0, (F.col("weekday_avg") - F.col("weekend_avg")) / F.col("weekday_avg") * 100)
    info = F.lit("info")
    return _rules(j, ["region"], [
        ("peak_demand", F.col("peak_mw").isNotNull(), info, F.col("peak_mw")),
        ("ramp_rate", F.col("max_ramp") > 0, info, F.col("max_ramp")),
        ("capacity_pct", use > 75, F.when(use > 85, "warning").otherwise("notable"), use),
        ("weekday_weekend_diff", (F.abs(diff) > 3) & (F.col("horizon") >= 168), info, diff),
        ("min_demand", F.col("min_mw") != 0, info, F.col("min_mw")),
    ])


def backtest_stats(graded: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Best and worst model, spread, and the served model's bias and hourly errors."""
    keys = list(keys)
    per = graded.groupBy(*keys, "model").agg(
        mt.mape().alias("mape"), mt.rmse().alias("rmse"), mt.r2().alias("r2"), F.avg(mt.residual()).alias("mean_bias"), F.avg("actual").alias("avg_actual"),
        F.avg(F.when(F.hour("ts").between(14, 18), F.abs(mt.residual()))).alias("peak_err"),
        F.avg(F.when((F.hour("ts") >= 22) | (F.hour("ts") <= 6), F.abs(mt.residual()))).alias("offpeak_err"))
    best = per.groupBy(*keys).agg(
        F.min_by("model", F.struct("mape", "model")).alias("best_model"), F.max_by("model", F.struct("mape", "model")).alias("worst_model"),
        (F.max("mape") - F.min("mape")).alias("mape_spread"))
    return per.join(best, keys)


def backtest_rules(s: DataFrame, horizon: str, keys: Sequence[str] = ("region", "model")) -> DataFrame:
    g = grade(F.col("mape"), horizon)
    bias, ratio = F.abs("mean_bias"), F.when(F.col("offpeak_err") > 0, F.col("peak_err") / F.col("offpeak_err"))
    info = F.lit("info")
    return _rules(s, keys, [
        ("mape", F.col("mape").isNotNull(), F.when(g == "rollback", "warning").when(g == "acceptable", "notable").otherwise("info"), F.col("mape")),
        ("r2", F.col("r2").isNotNull(), F.when(F.col("r2") > 0.95, "info").otherwise("notable"), F.col("r2")),
        ("model_comparison", (F.col("best_model") != F.col("worst_model")) & (F.col("mape_spread") > 0.3), info, F.col("mape_spread")),
        ("bias", bias > 50, F.when(bias > 200, "warning").otherwise("notable"), F.col("mean_bias")),
        ("error_by_hour", ratio > 1.3, info, ratio),
        ("rmse", F.col("rmse").isNotNull(), info, F.col("rmse")),
    ])


def ensemble_weight_insight(weights: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Members by weight, the dominant one first; as many rows a group as there are models."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "model")))
    g = weights.filter("weight IS NOT NULL").groupBy(*keys).agg(order.alias("m"))
    parts = F.transform("m", lambda x: F.concat(x["model"], F.lit(" "), F.round(-x["w"] * 100).cast("long").cast("string"), F.lit("%")))
    first = F.get("m", F.lit(0))["model"]
    text = F.concat(F.lit("Ensemble weights: "), F.array_join(parts, ", "), F.lit(" \u2014 "), first, F.lit(" dominates due to lowest individual MAPE."))
    return g.select(*keys, F.lit("ensemble_weights").alias("metric"), F.lit("info").alias("severity"), first.alias("dominant"), text.alias("text"))


def r2_band(r2: Column) -> Column:
    return F.when(r2 > 0.97, "excellent").when(r2 > 0.95, "good").when(r2 > 0.90, "moderate").otherwise("weak")


def generation_rules(s: DataFrame, capacity: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Rules over the net-load statistics and the capacity of each region."""
    j = s.join(capacity.select("region", "capacity_mw"), "region", "left").withColumn("capacity_mw", F.coalesce("capacity_mw", F.lit(50000.0)))
    cap = F.col("capacity_mw")
    low, swing = F.try_divide(F.col("min_net"), cap) * 100, F.try_divide(F.col("peak_net") - F.col("min_net"), cap) * 100
    info = F.lit("info")
    return _rules(j, keys, [
        ("renewable_pct", F.col("renewable_pct").isNotNull(), F.when(F.col("renewable_pct") > 40, "notable").otherwise("info"), F.col("renewable_pct")),
        ("evening_ramp", F.col("evening_ramp") > 0, F.when(F.col("evening_ramp") > cap * 0.03, "warning").otherwise("info"), F.col("evening_ramp")),
        ("min_net_load", low < 25, F.when(low < 15, "notable").otherwise("info"), F.col("min_net")),
        ("curtailment_hours", (F.col("peak_net") > 0) & (F.col("curtailment_hours") > 0), F.when(F.col("curtailment_hours") > 24, "warning").otherwise("notable"), F.col("curtailment_hours")),
        ("net_load_range", swing > 30, info, F.col("peak_net") - F.col("min_net")),
        ("solar_peak_pct", F.col("solar_peak_pct") > 30, info, F.col("solar_peak_pct")),
    ])


def penetration(pct: Column) -> Column:
    return F.when(pct > 30, "high").when(pct > 15, "moderate").otherwise("low")


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Changes between two captures of each region, one row per change.

    Snapshots hold peak_mw, avg_24h_mw, forecast_peak_mw, alert_count,
    renewable_pct, mape (map) and sources (map).
    """
    cols = ["peak_mw", "avg_24h_mw", "forecast_peak_mw", "alert_count", "renewable_pct", "mape", "sources"]
    j = previous.select("region", *[F.col(c).alias(f"o_{c}") for c in cols]).join(current.select("region", *[F.col(c).alias(f"n_{c}") for c in cols]), "region")
    pct = {c: pct_change(F.col(f"o_{c}"), F.col(f"n_{c}")) for c in cols[:3]}
    more, pp = F.col("n_alert_count") - F.col("o_alert_count"), F.col("n_renewable_pct") - F.col("o_renewable_pct")

    def change(on, order, category, item, sev, value):
        return F.when(on, F.struct(F.lit(order).alias("ord"), F.lit(category).alias("category"), item.alias("item"), sev.alias("severity"), value.cast("double").alias("value")))

    fixed = F.array(
        change(F.abs(pct["peak_mw"]) > 5, 1, "demand", F.lit("peak"), F.when(F.abs(pct["peak_mw"]) > 10, "notable").otherwise("info"), pct["peak_mw"]),
        change(F.abs(pct["avg_24h_mw"]) > 5, 2, "demand", F.lit("average"), F.lit("info"), pct["avg_24h_mw"]),
        change(F.abs(pct["forecast_peak_mw"]) > 5, 3, "forecast", F.lit("peak"), F.lit("notable"), pct["forecast_peak_mw"]),
        change((more > 0) | ((more < 0) & (F.col("n_alert_count") == 0)), 4, "alerts", F.lit("count"), F.when(more > 0, "warning").otherwise("info"), more),
        change(F.abs(pp) > 3, 5, "generation", F.lit("renewable share"), F.lit("info"), F.col("n_renewable_pct")))

    def model(k, new):
        d = new - F.col("o_mape")[k]
        return change(F.abs(d) > 2, 6, "models", k, F.when(d > 0, "warning").otherwise("info"), new)

    def source(k, new):
        old = F.col("o_sources")[k]
        return change((old != "") & (new != "") & (old != new), 7, "data", k, F.when(new.isin("stale", "demo", "error"), "warning").otherwise("info"), F.lit(None))

    models = F.transform(F.map_entries("n_mape"), lambda e: model(e["key"], e["value"]))
    sources = F.transform(F.map_entries("n_sources"), lambda e: source(e["key"], e["value"]))
    return j.select("region", F.inline(F.array_compact(F.concat(fixed, models, sources))))


def persona_changes(changes: DataFrame, cap: int = MAX_CHANGES) -> DataFrame:
    """Most severe changes relevant to each persona, capped."""
    who = F.create_map(*[x for c, ps in CHANGE_RELEVANCE.items() for x in (F.lit(c), F.array(*[F.lit(p) for p in ps]))])
    sev = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    x = changes.select("*", F.explode(who[F.col("category")]).alias("persona"))
    w = Window.partitionBy("region", "persona").orderBy(sev[F.col("severity")], "ord", "item")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)
