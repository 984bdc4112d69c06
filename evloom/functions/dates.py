"""UTC parsing and the weekly check slot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_utc(c: Column) -> Column:
    """ISO text with an explicit zone to a timestamp; text without a zone gives null."""
    return F.when(c.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})\z"), F.try_to_timestamp(c))


def next_weekly_check(now: Column, zone: str = "Europe/Madrid", weekday: int = 0, hour: int = 8) -> Column:
    """First local ``weekday`` at ``hour`` strictly after ``now``, as a UTC timestamp."""
    local = F.from_utc_timestamp(now, zone)
    ahead = F.pmod(F.lit(weekday) - F.weekday(local), F.lit(7))
    day = F.date_add(F.to_date(local), ahead)
    at = lambda d: F.to_timestamp(d) + F.make_interval(hours=F.lit(hour))
    candidate = F.when(at(day) > local, at(day)).otherwise(at(F.date_add(day, 7)))
    return F.to_utc_timestamp(candidate, zone)
