"""Raw feeds to typed tables. Bad values become null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
WEATHER_VARIABLES = [
    "temperature_2m", "apparent_temperature", "relative_humidity_2m", "dew_point_2m", "wind_speed_10m",
    "wind_speed_80m", "wind_speed_120m", "wind_direction_10m", "shortwave_radiation",
    "direct_normal_irradiance", "diffuse_radiation", "cloud_cover", "precipitation", "snowfall",
    "surface_pressure", "soil_temperature_0cm", "weather_code",
]
SEVERITY = {"Extreme": "critical", "Severe": "critical", "Moderate": "warning", "Minor": "info", "Unknown": "info"}
DESCRIPTION_CHARS = 500
SUPER_ZONES = {
    "WEST": ["WEST", "GENESE"],
    "CENTRAL": ["CENTRL", "MHK VL"],
    "NORTH_CAPITAL": ["NORTH", "CAPITL"],
    "LOWER_HUDSON": ["HUD VL", "MILLWD", "DUNWOD"],
    "METRO": ["N.Y.C.", "LONGIL"],
}


def text_number(c: str | Column) -> Column:
    """Double from text; empty, unparseable, NaN and infinite texts are null."""
    v = F.expr(f"try_cast(trim({c}) AS DOUBLE)") if isinstance(c, str) else c
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def period_hour(c: str = "period") -> Column:
    """Timestamp of an hour text such as 2024-01-01T00, null if malformed."""
    return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(p)) for p in
                        ("yyyy-MM-dd'T'HH", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")])


def parse_demand(records: DataFrame) -> DataFrame:
    """Long feed (region, period, type D or DF, value text) to demand and day-ahead.

    Only hours with a ``D`` record are kept; zero and unreadable values are null.
    """
    mw = F.nullif(text_number("value"), F.lit(0.0))
    return (
        records.select("region", period_hour().alias("ts"), "type", mw.alias("mw"))
        .groupBy("region", "ts")
        .agg(
            F.max(F.when(F.col("type") == "D", F.col("mw"))).alias("demand_mw"),
            F.max(F.when(F.col("type") == "DF", F.col("mw"))).alias("forecast_mw"),
            F.count_if(F.col("type") == "D").alias("_d"),
        )
        .filter("_d > 0").drop("_d")
    )


def join_day_ahead(records: DataFrame) -> DataFrame:
    """The same table by a left self-join of the two record types, each collapsed to one row an hour first."""
    mw = F.nullif(text_number("value"), F.lit(0.0))
    long = records.select("region", period_hour().alias("ts"), "type", mw.alias("mw"))
    d = long.filter("type = 'D'").groupBy("region", "ts").agg(F.max("mw").alias("demand_mw"))
    df = long.filter("type = 'DF'").groupBy("region", "ts").agg(F.max("mw").alias("forecast_mw"))
    return d.join(df, ["region", "ts"], "left")


def parse_generation(records: DataFrame) -> DataFrame:
    """Fuel records; the fuel falls back to its type name, then to unknown."""
    return records.select(
        "region", period_hour().alias("ts"),
        F.coalesce("fueltype", "type_name", F.lit("unknown")).alias("fuel_type"),
        text_number("value").alias("generation_mw"),
    )


def parse_interchange(records: DataFrame) -> DataFrame:
    return records.select(
        period_hour().alias("ts"), F.coalesce("fromba", F.lit("")).alias("from_ba"),
        F.coalesce("toba", F.lit("")).alias("to_ba"), text_number("value").alias("interchange_mw"),
    )


def _hourly_schema(variables: Sequence[str]) -> str:
    return "time ARRAY<STRING>, " + ", ".join(f"`{v}` ARRAY<DOUBLE>" for v in variables)


def _rows_of(hourly: Column, variables: Sequence[str]) -> Column:
    """Array of hour structs from parallel arrays; a missing variable is null."""
    return F.transform(
        F.coalesce(hourly["time"], F.array().cast("array<string>")),
        lambda t, i: F.struct(
            F.to_timestamp(t).alias("ts"),
            *[F.get(hourly[v], i).alias(v) for v in variables],
        ),
    )


def parse_weather(payloads: DataFrame, payload: str = "payload", variables: Sequence[str] = WEATHER_VARIABLES) -> DataFrame:
    """Column-array JSON payload to one row per hour, other columns kept."""
    doc = F.from_json(payload, f"STRUCT<hourly: STRUCT<{_hourly_schema(variables).replace(' ARRAY', ': ARRAY')}>>")
    keep = [c for c in payloads.columns if c != payload]
    return payloads.select(*keep, doc["hourly"].alias("_h")).select(*keep, F.inline(_rows_of(F.col("_h"), variables)))


def parse_weather_points(payloads: DataFrame, payload: str = "payload", variables: Sequence[str] = WEATHER_VARIABLES) -> DataFrame:
    """A list of payloads, one per sampling point, to rows keyed by ``point_id``."""
    schema = f"ARRAY<STRUCT<hourly: STRUCT<{_hourly_schema(variables).replace(' ARRAY', ': ARRAY')}>>>"
    keep = [c for c in payloads.columns if c != payload]
    points = payloads.select(*keep, F.posexplode(F.from_json(payload, schema)).alias("point_id", "_p"))
    return points.select(*keep, "point_id", F.inline(_rows_of(F.col("_p")["hourly"], variables)))


ALERT_PROPS = ("id STRING, event STRING, headline STRING, description STRING, severity STRING, urgency STRING, "
               "certainty STRING, onset STRING, expires STRING, areaDesc STRING")


def severity_of(c: str | Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.coalesce(words[F.col(c) if isinstance(c, str) else c], F.lit("info"))


def parse_alerts(payloads: DataFrame, payload: str = "payload", state: str = "state") -> DataFrame:
    """Alert feature collections to one row per alert."""
    schema = f"STRUCT<features: ARRAY<STRUCT<properties: STRUCT<{ALERT_PROPS.replace(' STRING', ': STRING')}>>>>"
    p = payloads.select(state, F.explode(F.from_json(payload, schema)["features"]["properties"]).alias("p"))
    unknown = F.lit("Unknown")
    sev = F.coalesce("p.severity", unknown)
    areas = F.filter(F.transform(F.split("p.areaDesc", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return p.select(
        F.coalesce("p.id", F.lit("")).alias("id"), F.coalesce("p.event", unknown).alias("event"),
        F.coalesce("p.headline", F.lit("")).alias("headline"),
        F.substring(F.coalesce("p.description", F.lit("")), 1, DESCRIPTION_CHARS).alias("description"),
        severity_of(sev).alias("severity"), sev.alias("noaa_severity"),
        F.coalesce("p.urgency", unknown).alias("urgency"), F.coalesce("p.certainty", unknown).alias("certainty"),
        F.try_to_timestamp("p.onset").alias("onset"), F.try_to_timestamp("p.expires").alias("expires"),
        F.coalesce(areas, F.array().cast("array<string>")).alias("areas"), F.array(state).alias("states"),
    )


def last_known_good(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Per key, the first source in order that has any non-null value."""
    tagged = [s.withColumn("_priority", F.lit(k)) for k, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    best = every.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min("_priority").alias("_priority"))
    return every.join(best, [*keys, "_priority"]).withColumnRenamed("_priority", "source")


def covers_days(df: DataFrame, keys: Sequence[str], start, end, ts: str = "ts") -> DataFrame:
    """Does each key's segment span the wanted days (compared by day)?"""
    return df.groupBy(*keys).agg(
        ((F.to_date(F.min(ts)) <= F.lit(start).cast("date")) & (F.to_date(F.max(ts)) >= F.lit(end).cast("date"))).alias("covered"))


def metadata_history(raw: DataFrame) -> DataFrame:
    """Model metadata records (region, model, version, trained_at, mape), latest marked."""
    known = raw.filter("trained_at IS NOT NULL")
    w = Window.partitionBy("region", "model").orderBy(F.desc("trained_at"), F.desc("version"))
    return known.withColumn("is_latest", F.row_number().over(w) == 1)


def latest_metadata(raw: DataFrame) -> DataFrame:
    """Latest version per region and model, by one partial aggregate."""
    pick = F.max(F.struct("trained_at", "version", "mape")).alias("m")
    return raw.filter("trained_at IS NOT NULL").groupBy("region", "model").agg(pick).select(
        "region", "model", "m.trained_at", "m.version", "m.mape")


def zonal_hourly(samples: DataFrame, zone: str = "zone", value: str = "load_mw", ts: str = "ts") -> DataFrame:
    """Five-minute zone samples to hourly means, long."""
    return samples.filter(F.col(value).isNotNull()).groupBy(zone, F.date_trunc("hour", ts).alias(ts)).agg(F.avg(value).alias(value))


def super_zones(hourly: DataFrame, mapping: dict[str, Sequence[str]] = SUPER_ZONES, zone: str = "zone",
                value: str = "load_mw", ts: str = "ts") -> DataFrame:
    """Hourly super-zone sums, only where every member reported the hour."""
    member = F.create_map(*[F.lit(x) for s, ms in mapping.items() for m in ms for x in (m, s)])
    size = F.create_map(*[F.lit(x) for s, ms in mapping.items() for x in (s, len(ms))])
    return (
        hourly.withColumn("super_zone", member[F.col(zone)]).filter("super_zone IS NOT NULL")
        .groupBy("super_zone", ts).agg(F.sum(value).alias(value), F.count("*").alias("_n"))
        .filter(F.col("_n") == size[F.col("super_zone")]).drop("_n")
    )


def explode_ticks(ticks: DataFrame) -> DataFrame:
    """Timing log lines to one row per tick and phase."""
    return ticks.select("tick", "elapsed_s", F.explode("phases").alias("phase", "block")).select(
        "tick", "elapsed_s", "phase", "block.total_s", "block.n")
