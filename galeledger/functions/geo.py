"""Web-Mercator projection, pixel mapping and the colour ramp."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .expr import as_col

EARTH_RADIUS_M = 6378137.0
MAX_LAT = math.pi / 2 - 1e-6


def mercator_x(lng) -> Column:
    return EARTH_RADIUS_M * F.radians(as_col(lng))


def mercator_y(lat) -> Column:
    lat = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), F.radians(as_col(lat))))
    return EARTH_RADIUS_M * F.log(F.tan(math.pi / 4 + lat / 2))


def pixel_x(lng, frame: dict) -> Column:
    return (mercator_x(lng) - frame["min_x"]) / (frame["max_x"] - frame["min_x"]) * frame["width"]


def pixel_y(lat, frame: dict) -> Column:
    """Row 0 is the northern edge."""
    return (1 - (mercator_y(lat) - frame["min_y"]) / (frame["max_y"] - frame["min_y"])) * frame["height"]


def ramp(norm) -> tuple[Column, Column, Column]:
    """Green to yellow to red over [0, 1]; returns (r, g, b)."""
    norm = as_col(norm)
    low = norm < 0.5
    half_up = lambda x: F.floor(x + 0.5).cast("int")
    red = F.when(low, half_up(255 * (norm / 0.5))).otherwise(F.lit(255))
    green = F.when(low, F.lit(255)).otherwise(half_up(255 * (1 - (norm - 0.5) / 0.5)))
    return red, green, F.lit(0)


def zoom_scaled(value, zoom) -> Column:
    return as_col(value) / F.pow(F.lit(2.0), as_col(zoom) / 6.0)
