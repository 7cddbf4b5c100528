"""Kernel-density raster, normalisation and polygon mask."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import EARTH_RADIUS_M, MAX_LAT, pixel_x, pixel_y, ramp
from ..session import spread

KERNEL_RADIUS_PX = 40
CANVAS_WIDTH_PX = 2000


def ring_vertices(polygons: DataFrame) -> DataFrame:
    """(poly_id, ring_id, i, lng, lat) from GeoJSON rings: array of rings of [lng, lat]."""
    rings = polygons.select("poly_id", F.posexplode("rings").alias("ring_id", "_ring"))
    points = rings.select("poly_id", "ring_id", F.posexplode("_ring").alias("i", "_p"))
    return points.select("poly_id", "ring_id", "i", F.col("_p")[0].alias("lng"), F.col("_p")[1].alias("lat"))


def bounding_box(vertices: DataFrame) -> DataFrame:
    return vertices.agg(
        F.min("lat").alias("south"), F.min("lng").alias("west"), F.max("lat").alias("north"), F.max("lng").alias("east")
    )


def frame_of(south: float, west: float, north: float, east: float, width: int = CANVAS_WIDTH_PX) -> dict:
    """Canvas frame: Mercator bounds, and a height that keeps the Mercator aspect."""
    x = lambda lng: EARTH_RADIUS_M * math.radians(lng)
    y = lambda lat: EARTH_RADIUS_M * math.log(math.tan(math.pi / 4 + max(-MAX_LAT, min(MAX_LAT, math.radians(lat))) / 2))
    min_x, max_x, min_y, max_y = x(west), x(east), y(south), y(north)
    height = math.floor(width * ((max_y - min_y) / (max_x - min_x)) + 0.5)
    return {"min_x": min_x, "max_x": max_x, "min_y": min_y, "max_y": max_y, "width": width, "height": height}


def to_pixels(points: DataFrame, frame: dict) -> DataFrame:
    return points.withColumn("x", pixel_x("lng", frame)).withColumn("y", pixel_y("lat", frame))


def density_raster(points: DataFrame, frame: dict, radius: int = KERNEL_RADIUS_PX, value: str = "value") -> DataFrame:
    """(px, py, intensity): every point adds value * (1 - d / radius) around its pixel.

    The kernel moves by whole pixels, so points of one pixel act as one point of
    their summed value. Summing first bounds the fan-out by the canvas, not by the
    number of points.
    """
    spots = to_pixels(points, frame).groupBy(F.floor("x").alias("cx"), F.floor("y").alias("cy")).agg(F.sum(value).alias("_v"))
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    fan = spread(spots, "cx", "cy").withColumn("_dx", F.explode(offsets)).withColumn("_dy", F.explode(offsets))
    d2 = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
    px, py = F.col("cx") + F.col("_dx"), F.col("cy") + F.col("_dy")
    hits = fan.where(
        (d2 <= radius * radius) & (px >= 0) & (px < frame["width"]) & (py >= 0) & (py < frame["height"])
    ).select(px.alias("px"), py.alias("py"), (F.col("_v") * (1 - F.sqrt(d2.cast("double")) / radius)).alias("_a"))
    return hits.groupBy("px", "py").agg(F.sum("_a").alias("intensity"))


def coloured(raster: DataFrame) -> DataFrame:
    """Intensity over the global maximum (0 when the maximum is not above 0), with ramp colours."""
    top = raster.agg(F.max("intensity")).scalar()
    red, green, blue = ramp("norm")
    return (
        raster.withColumn("_top", top)
        .withColumn("norm", F.when(F.col("_top") > 0, F.col("intensity") / F.col("_top")).otherwise(0.0))
        .drop("_top")
        .withColumns({"r": red, "g": green, "b": blue})
    )


def scanline_crossings(vertices: DataFrame, frame: dict) -> DataFrame:
    """(py, xs): where each pixel row's centre line crosses the polygon edges.

    The list of a row is bounded by the number of edges of the polygon.
    """
    v = to_pixels(vertices, frame).select("poly_id", "ring_id", "i", "x", "y")
    ordered = v.groupBy("poly_id", "ring_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("_r"))
    edges = ordered.select(F.explode(F.zip_with(
        "_r", F.concat(F.slice(F.col("_r"), F.lit(2), F.size("_r")), F.slice("_r", 1, 1)),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )).alias("e")).select("e.*").where("y1 <> y2")
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    lo = F.greatest(F.lit(0), F.ceil(top - 0.5)).cast("bigint")
    hi = F.least(F.lit(frame["height"] - 1), F.ceil(bottom - 0.5) - 1).cast("bigint")
    rows = edges.where(lo <= hi).withColumn("py", F.explode(F.sequence(lo, hi)))
    cross = F.col("x1") + (F.col("py") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return rows.groupBy("py").agg(F.array_sort(F.collect_list(cross)).alias("xs"))


def mask_polygon(raster: DataFrame, vertices: DataFrame, frame: dict) -> DataFrame:
    """Cells whose centre lies inside the rings (even-odd rule, so inner rings are holes)."""
    lines = scanline_crossings(vertices, frame)
    right_of = F.size(F.filter("xs", lambda x: x > F.col("px") + 0.5))
    return raster.join(lines, "py").where(right_of % 2 == 1).select(*raster.columns)
