"""French calendar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Yearly public holidays (month, day).
FIXED_HOLIDAYS = [(1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)]
# Days after Easter Sunday (Easter Monday, Ascension, Whit Monday).
EASTER_HOLIDAYS = [1, 39, 50]
# School holiday periods of zone C, both ends included.
SCHOOL_PERIODS_ZONE_C = [("2025-07-05", "2025-08-31")]


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the Meeus/Jones/Butcher rule."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    a, b, c = year % 19, div(year, 100), year % 100
    h = (a * 19 + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    w = ((b % 4) * 2 + div(c, 4) * 2 + 32 - h - c % 4) % 7
    m = div(a + h * 11 + w * 22, 451)
    offset = h + w - m * 7 + 114
    return F.make_date(year, div(offset, 31), offset % 31 + 1)


def is_public_holiday(day: Column) -> Column:
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    fixed = month_day.isin([m * 100 + d for m, d in FIXED_HOLIDAYS])
    movable = F.datediff(day, easter_sunday(F.year(day))).isin(EASTER_HOLIDAYS)
    return fixed | movable


def is_school_holiday(day: Column) -> Column:
    hit = F.lit(False)
    for start, end in SCHOOL_PERIODS_ZONE_C:
        hit = hit | day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return F.coalesce(hit, F.lit(False))
