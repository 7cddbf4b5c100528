"""Month, quarter, project-year and cyclical time columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .expr import as_col


def month_start(c) -> Column:
    return F.trunc(as_col(c).cast("date"), "MM")


def quarter_start(c) -> Column:
    return F.trunc(as_col(c).cast("date"), "QUARTER")


def hour_start(c) -> Column:
    """Hour floor that keeps the zone-less type of market and test timestamps."""
    return F.date_trunc("HOUR", as_col(c)).cast("timestamp_ntz")


def month_index(c) -> Column:
    """Months since year 0: differences are whole months, unlike months_between."""
    c = as_col(c)
    return F.year(c) * 12 + F.month(c) - 1


def quarter_ordinal(c) -> Column:
    c = as_col(c)
    return F.year(c) * 4 + F.quarter(c) - 1


def quarter_name(c) -> Column:
    """``2015Q1``."""
    c = as_col(c)
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def months_between_starts(later, earlier) -> Column:
    return month_index(later) - month_index(earlier)


def years_ahead(later, earlier) -> Column:
    return months_between_starts(later, earlier) / 12.0


def project_month(c, cod) -> Column:
    return months_between_starts(c, cod) + 1


def project_year(c, cod) -> Column:
    return (F.floor(months_between_starts(c, cod) / 12) + 1).cast("int")


def micros(c) -> Column:
    """Microseconds since the epoch (UTC) for any date or timestamp type."""
    return F.unix_micros(as_col(c).cast("timestamp"))


def from_micros(c) -> Column:
    return F.timestamp_micros(as_col(c)).cast("timestamp_ntz")


def floor_to(c, minutes: int) -> Column:
    step = minutes * 60_000_000
    m = micros(c)
    return from_micros(m - F.pmod(m, F.lit(step)))


def ceil_to(c, minutes: int) -> Column:
    step = minutes * 60_000_000
    m = micros(c)
    return from_micros(m + F.pmod(-m, F.lit(step)))


def cyclical(c) -> dict[str, Column]:
    """Hour-of-day and day-of-year on the unit circle."""
    c = as_col(c)
    hour = 2 * math.pi * F.hour(c) / 24
    day = 2 * math.pi * F.dayofyear(c) / 365.25
    return {
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour),
        "doy_sin": F.sin(day), "doy_cos": F.cos(day),
    }


def season_dummies(season, levels) -> dict[str, Column]:
    """0/1 columns for every level but the first (the base level)."""
    season = as_col(season)
    return {f"m_{k}": F.when(season == k, 1.0).otherwise(0.0) for k in list(levels)[1:]}
