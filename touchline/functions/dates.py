"""Dates as column expressions.  Timestamps are UTC; a null gives a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """An ISO date or date and time, or null where it is none."""
    return F.try_to_timestamp(text)


def is_later_day(at: Column, than: Column) -> Column:
    return F.to_date(at) > F.to_date(than)


def is_same_day(at: Column, other: Column) -> Column:
    return F.to_date(at) == F.to_date(other)


def season_start(at: Column) -> Column:
    """1 July of the year, or before July of the last one."""
    return F.make_date(F.year(at) - F.when(F.month(at) < 7, 1).otherwise(0), F.lit(7), F.lit(1))


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def short_date(at: Column) -> Column:
    return F.date_format(at, "dd.MM.")


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def age_seconds(at: Column, now: Column) -> Column:
    """Whole seconds from ``at`` to ``now``."""
    return F.floor((_micros(now) - _micros(at)) / 1000000)


def age_days(at: Column, now: Column) -> Column:
    """Days with their fraction."""
    return (_micros(now) - _micros(at)) / 86400000000.0
