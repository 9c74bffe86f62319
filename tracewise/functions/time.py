"""Time arithmetic on wall-clock times, the same in any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def _micros_of(interval: Column) -> Column:
    return (interval.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")


def micros(ts: Column) -> Column:
    """Microseconds of the wall-clock time, counted from 1970-01-01."""
    return _micros_of(ts - F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))


def minutes_between(end: Column, start: Column) -> Column:
    return _micros_of(end - start) / F.lit(float(MICROS_PER_MINUTE))
