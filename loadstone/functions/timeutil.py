"""Timestamp normalisation. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(text: str | Column) -> Column:
    """Timestamp of a text: naive stamps are taken as UTC, aware ones converted."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def canonical_hour(text: str | Column) -> Column:
    """ISO UTC text of any readable stamp, else null."""
    return F.date_format(utc(text), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def local_to_utc(ts: str | Column, zone: str) -> Column:
    """UTC instant of a local wall time; null when it is ambiguous or skipped."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    u = F.to_utc_timestamp(ts, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    same = F.from_utc_timestamp(u, zone) == ts
    twice = (F.from_utc_timestamp(u + hour, zone) == ts) | (F.from_utc_timestamp(u - hour, zone) == ts)
    return F.when(same & ~twice, u)
