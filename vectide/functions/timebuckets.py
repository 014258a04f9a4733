"""Buckets of UTC time given as milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS


def floor_bucket(ms: Column, width: int) -> Column:
    """Start of the bucket of that width counted from 1970 (negative times round down)."""
    return ms - F.pmod(ms, F.lit(width))


def day_start(ms: Column) -> Column:
    return floor_bucket(ms, DAY_MS)


def week_start(ms: Column) -> Column:
    """Start of the week from Monday; 1970-01-01 was a Thursday."""
    return ms - F.pmod(ms + F.lit(3 * DAY_MS), F.lit(WEEK_MS))
