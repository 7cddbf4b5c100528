"""Boundary-layer wind and air-density columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .expr import as_col

EPS = 1e-6


def speed(u, v) -> Column:
    u, v = as_col(u), as_col(v)
    return F.sqrt(u * u + v * v)


def direction_from(u, v) -> Column:
    """Meteorological direction in degrees the wind blows from."""
    return F.pmod(F.degrees(F.atan2(-as_col(u), -as_col(v))) + 360.0, F.lit(360.0))


def shear_exponent(ws10, ws100) -> Column:
    return F.log((as_col(ws100) + EPS) / (as_col(ws10) + EPS)) / math.log(10.0)


def at_hub(ws10, hub_height_m, alpha) -> Column:
    return as_col(ws10) * F.pow(as_col(hub_height_m) / 10.0, as_col(alpha))


def air_density(sp, t2m, d2m=None) -> Column:
    """Moist-air density from the dew point; dry air where the dew point is unknown."""
    sp, t2m = as_col(sp), as_col(t2m)
    dry = sp / (287.05 * t2m)
    if d2m is None:
        return dry
    d2m = as_col(d2m)
    vapour = 611.2 * F.exp(17.67 * (d2m - 273.15) / (d2m - 29.65))
    humidity = 0.622 * vapour / (sp - 0.378 * vapour)
    return F.coalesce(sp / (287.05 * (t2m * (1 + 0.61 * humidity))), dry)


def swept_area(rotor_diameter_m) -> Column:
    half = as_col(rotor_diameter_m) / 2.0
    return math.pi * half * half


def specific_power(rated_power_kw, rotor_diameter_m) -> Column:
    """Rated W per swept square metre."""
    return as_col(rated_power_kw) * 1000.0 / swept_area(rotor_diameter_m)
