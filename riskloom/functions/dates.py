"""Calendar and elapsed-time expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def decay_rate(half_life_days: float) -> float:
    return math.log(2) / half_life_days


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour periods from start to end (not a count of midnights)."""
    return F.timestamp_diff("DAY", start, end)


def decay_weight(ts: Column, end: Column, lam: float) -> Column:
    return F.exp(F.lit(-lam) * whole_days(ts, end))


def completed_years(born: Column, at: Column) -> Column:
    """Age in full years; a 29 February birthday counts on 28 February of a common year."""
    return F.floor(F.months_between(at, born) / 12).cast("int")


def completed_years_strict(born: Column, at: Column) -> Column:
    """Age in full years; a 29 February birthday counts on 1 March of a common year."""
    month_day_at = F.month(at) * 100 + F.dayofmonth(at)
    month_day_born = F.month(born) * 100 + F.dayofmonth(born)
    return F.year(at) - F.year(born) - (month_day_at < month_day_born).cast("int")


def iso_weekday(day: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(day) + 1


def week_ending_monday(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "MON")


def months_before(ts: Column, months: int) -> Column:
    return ts - F.make_interval(F.lit(0), F.lit(months))


def days_before(day: Column, days: int) -> Column:
    return day - F.make_dt_interval(F.lit(days))
