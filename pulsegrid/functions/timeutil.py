"""Epoch seconds and their display forms; all logic is on BIGINT seconds, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(ts: str) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP_NTZ column, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def iso(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_date(t: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / 86400).cast("int"))


def local_day(t: Column, hours: int = 8) -> Column:
    """The calendar day at a fixed offset from UTC."""
    return utc_date(t + hours * 3600)


def floor_to(t: Column, step: int = 60) -> Column:
    return t - F.pmod(t, F.lit(step))
