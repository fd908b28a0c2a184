"""Eight-day periods of a year, numbered from 1 (the last has 5 or 6 days)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import PERIODS


def period(t: Column) -> Column:
    return F.least(F.lit(PERIODS), F.floor((F.dayofyear(t) - 1) / 8).cast("int") + 1)


def days_in_period(year: Column, p: Column) -> Column:
    return F.when(p < PERIODS, F.lit(8)).otherwise(F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) - 360)


def period_start(year: Column, p: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), ((p - 1) * 8).cast("int"))


def period_end(year: Column, p: Column) -> Column:
    return F.least(F.date_add(period_start(year, p), 7), F.make_date(year, F.lit(12), F.lit(31)))


def timeline(year: Column, p: Column) -> Column:
    """Position on the continuous sequence of periods."""
    return year * PERIODS + p


def season(p: Column) -> tuple[Column, Column]:
    angle = p * (2 * 3.141592653589793 / PERIODS)
    return F.sin(angle), F.cos(angle)
