"""Query registry: one DataFrame query and, where SQL can say it, one oracle."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadstone.plans.oracle import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
# Averages of cents often end in an exact half at the last digit, where the order
# of summation would decide the rounding; the nudge settles it the same way.
NUDGE = 3.14159e-8


def presentable(df: DataFrame) -> DataFrame:
    """Last projection: zone-less timestamps, long integers, rounded doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + NUDGE, DIGITS)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, ctes: str = "", sql: str | None = None, d: str = "", i: str = ""):
    """Register a query.

    ``ctes`` names the shared oracle tables, ``d`` its double columns (rounded on
    both sides) and ``i`` its integer columns (cast to BIGINT).
    """

    def wrap(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return presentable(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            casts = [f"round(CAST({c} AS DOUBLE) + {NUDGE}, {DIGITS}) + 0.0 AS {c}" for c in (d.split("|") if "|" in d else d.split())]
            casts += [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
            head = f"SELECT * REPLACE ({', '.join(casts)})" if casts else "SELECT *"
            ORACLES[name] = f"{head} FROM (\n{with_ctes(ctes, sql)}\n) q"
        return fn

    return wrap
