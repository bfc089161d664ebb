"""Clock handling. ``now`` is always a naive UTC ``datetime``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(now: datetime, shift_seconds: float = 0.0, kind: str = "timestamp_ntz") -> Column:
    """``now`` moved by ``shift_seconds`` as a literal, so scans can prune by it."""
    at = now + timedelta(seconds=shift_seconds)
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def epoch_micros(now: datetime) -> int:
    return int((now - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def age_seconds(col: Column, now: datetime) -> Column:
    return (F.lit(epoch_micros(now)) - micros(col)) / F.lit(1e6)


def age_hours(col: Column, now: datetime) -> Column:
    return (F.lit(epoch_micros(now)) - micros(col)) / F.lit(3.6e9)


def within(col: Column, now: datetime, seconds: float) -> Column:
    """Trailing window that is open on the left: ``col > now - seconds``."""
    return col > ts(now, -seconds)


def fmt(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def bucket(col: Column, width_seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``col`` (TIMESTAMP_NTZ)."""
    return F.timestamp_seconds(
        F.floor(micros(col) / F.lit(width_seconds * 1_000_000)) * F.lit(width_seconds)
    ).cast("timestamp_ntz")
