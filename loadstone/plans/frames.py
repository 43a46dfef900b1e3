"""

Every raw feed is collapsed to one row per series and hour by a partially
aggregated ``groupBy`` before any window sees it, so a hot series carries at most
one row an hour from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadstone.operators.series import hour_number, hour_spine, windowed
from loadstone.operators.vintage import vintages

FUEL_OF_EVENT = {"click": "WND", "view": "SUN", "purchase": "NG", "signup": "WAT", "error": "NUC"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Observed demand: region, ts, demand_mw; absent hours have no row."""
    return (
        events(spark, sf)
        .groupBy(F.col("event_type").alias("region"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.round(F.sum("value"), 2).alias("demand_mw"))
    )


def demand(spark: SparkSession, sf: str) -> DataFrame:
    """Dense hourly demand with the day-ahead arm (the value 24 hours earlier)."""
    spine = hour_spine(hourly(spark, sf), ["region"]).withColumn("h", hour_number("ts"))
    return windowed(
        spine, ["region"], "h",
        {"forecast_mw": lambda w: F.lag("demand_mw", 24).over(w)}, before=24,
    )


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Covariates per region and observed hour, from integer sums of the feed."""
    k = F.get_json_object("props", "$.k").cast("long")
    g = (
        events(spark, sf)
        .groupBy(F.col("event_type").alias("region"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.sum(k).alias("k"), F.sum("event_id").alias("e"), F.sum("user_id").alias("u"))
    )
    return g.select(
        "region", "ts",
        (20 + F.col("k") % 80).cast("double").alias("temperature_2m"),
        (F.col("e") % 101).cast("double").alias("relative_humidity_2m"),
        (F.col("u") % 60).cast("double").alias("wind_speed_80m"),
        ((F.col("e") * 7) % 1000).cast("double").alias("shortwave_radiation"),
        ((F.col("e") * 37) % 360).cast("double").alias("wind_direction_10m"),
        (F.col("k") % 101).cast("double").alias("cloud_cover"),
        F.element_at(F.array(*[F.lit(c) for c in (0, 1, 2, 3, 45, 61, 80)]),
                     (F.col("e") % 7 + 1).cast("int")).alias("weather_code"),
    )


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return demand(spark, sf).join(weather(spark, sf), ["region", "ts"], "left")


def generation(spark: SparkSession, sf: str) -> DataFrame:
    """Generation by fuel: region, ts, fuel_type, generation_mw."""
    fuel = F.create_map(*[F.lit(x) for kv in FUEL_OF_EVENT.items() for x in kv])
    return (
        events(spark, sf)
        .groupBy(
            F.concat(F.lit("U"), (F.col("user_id") % 8).cast("string")).alias("region"),
            F.date_trunc("hour", "ts").alias("ts"),
            fuel[F.col("event_type")].alias("fuel_type"),
        )
        .agg(F.round(F.sum("value"), 2).alias("generation_mw"))
    )


def interchange(spark: SparkSession, sf: str) -> DataFrame:
    """Directed flows: ts, from_ba, to_ba, interchange_mw."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("from_ba"))
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("to_ba"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber",
        (F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).alias("mw"))
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("ts", "from_ba", "to_ba")
        .agg(F.round(F.sum("mw"), 2).alias("interchange_mw"))
    )


def capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Capacity per nation: region, grid (its parent), capacity_mw, unreliable."""
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("n_name").alias("region"), F.col("r_name").alias("grid"))
        .agg(
            F.round(F.sum(F.abs("s_acctbal")), 2).alias("capacity_mw"),
            (F.max("n_nationkey") % 7 == 0).alias("unreliable"),
        )
    )


def nation_load(spark: SparkSession, sf: str) -> DataFrame:
    """Positive load per nation and day: customer orders, in capacity units."""
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("ts"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("region"), "ts")
        .agg((F.round(F.sum("o_totalprice"), 2) / 20).alias("demand_mw"))
    )


EPOCH = "2020-01-01 00:00:00"


def _order_hour(key: str):
    """Five regions share the order keys, one order an hour each."""
    region = F.concat(F.lit("R"), (F.col(key) % 5).cast("string")).alias("region")
    hour = F.floor(F.col(key) / 5).cast("int")
    target = F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(F.lit(0), hour)
    return region, hour, target


def _level(key: str):
    return 1000.0 + (F.col(key) % 977) * 10


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Bitemporal readings: region, target_ts, captured_at, d, df.

    Line ``n`` of an order is the value seen ``n`` hours after its hour. Each
    region revises in its own way; two regions lose the day-ahead feed for a while.
    """
    region, hour, target = _order_hour("l_orderkey")
    r, n, level = F.col("l_orderkey") % 5, F.col("l_linenumber"), _level("l_orderkey")
    d = (
        F.when(r == 0, F.col("l_extendedprice")).when(r == 1, level).when(r == 2, level + n * 0.3)
        .when(r == 3, F.when((n >= 6) & (F.col("l_orderkey") % 3 == 0), level * 1.1).otherwise(level))
        .otherwise(level + F.least(n, F.lit(3)) * 8)
    )
    dark = ((r == 2) & hour.between(500, 700)) | ((r == 1) & hour.between(1000, 1130))
    df = F.when((F.col("l_returnflag") != "N") & ~dark, F.round(d * (1 - F.col("l_discount")), 4))
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max(d).alias("d"), F.max(df).alias("df"))
        .select(region, target.alias("target_ts"), (target + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))).alias("captured_at"), "d", "df")
    )


def vintage(spark: SparkSession, sf: str) -> DataFrame:
    return vintages(readings(spark, sf))


def our_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Matured predictions of our arm on the vintage hours, one lead an hour."""
    region, _, target = _order_hour("o_orderkey")
    level, c = _level("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        region, target.alias("target_ts"),
        F.when(F.col("o_orderstatus") != "P", F.round(level * (90 + c % 21) / 100, 2)).alias("predicted"),
        F.when(c % 4 == 0, F.round(level * (95 + c % 11) / 100, 2)).alias("revised_df"),
        F.concat((F.lit(24) * (1 + c % 2)).cast("string"), F.lit("h")).alias("lead"),
    )


MODELS = {"lag24": 24, "lag48": 48, "lag168": 168}


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Graded forecasts, long: region, model, ts, predicted, actual, lead_hours, made_at, placeholder.

    Three seasonal arms on the dense spine; hours without a reading or without a
    prediction have no row. Lead is unknown on every seventh hour.
    """
    spine = hour_spine(hourly(spark, sf), ["region"]).withColumn("h", hour_number("ts"))
    lags = windowed(spine, ["region"], "h", {
        m: (lambda w, n=n: F.lag("demand_mw", n).over(w)) for m, n in MODELS.items()
    }, before=168)
    lead = F.when(F.col("h") % 7 != 0, 1 + F.col("h") % 30)
    return (
        lags.select("region", "ts", "h", F.col("demand_mw").alias("actual"),
                    F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in MODELS])))
        .filter("actual IS NOT NULL AND predicted IS NOT NULL")
        .select(
            "region", "model", "ts", "predicted", "actual", lead.cast("long").alias("lead_hours"),
            F.when(F.col("h") % 5 != 0, F.col("h") % 3 == 0).alias("placeholder"),
        )
    )


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alert records from events: id, severity words, expiry, state list."""
    sev = F.element_at(F.array(*[F.lit(s) for s in ("Extreme", "Severe", "Moderate", "Minor", "Unknown")]),
                       (F.col("event_id") % 5 + 1).cast("int"))
    return events(spark, sf).select(
        F.expr("event_id div 2").alias("id"), F.col("event_id").alias("arrival"),
        F.col("event_type").alias("event"), sev.alias("noaa_severity"),
        F.col("ts").alias("onset"),
        F.when(F.col("event_id") % 6 != 0,
               F.date_trunc("second", "ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 48).cast("int"))).alias("expires"),
        F.concat(F.lit("S"), (F.col("user_id") % 12).cast("string")).alias("state"),
    )
