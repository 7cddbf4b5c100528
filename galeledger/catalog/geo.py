"""G*: bounds, projection, density raster, colours and mask. The polygon is a
star over the nations, the points are customers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..operators import raster
from ..plans.heatmap import frame_for, heatmap
from .base import Tables, query, r, rounded, sql

WIDTH, RADIUS = 120, 6
_RAD = "(2.0::DOUBLE + n_regionkey % 2)"
_ANG = "(2 * pi() * n_nationkey / 25)"
VERT = f"SELECT 0 AS poly_id, n_nationkey AS i, 10 + {_RAD} * cos({_ANG}) AS lng, 50 + {_RAD} * sin({_ANG}) AS lat FROM nation"
POINTS = "SELECT c_custkey, 48 + (c_custkey * 7919 % 1000) / 250 AS lat, 8 + (c_custkey * 104729 % 1000) / 250 AS lng, abs(c_acctbal) / 1000 AS value FROM customer"
_X = "6378137.0::DOUBLE * radians({0})"
_Y = "6378137.0::DOUBLE * ln(tan(pi() / 4 + radians({0}) / 2))"
CANVAS = {
    "vert": VERT, "pts": POINTS,
    "box": "SELECT min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east FROM vert",
    "fr": f"SELECT *, CAST(floor({WIDTH} * ((y1 - y0) / (x1 - x0)) + 0.5) AS INT) AS h FROM (SELECT {_X.format('west')} AS x0, {_X.format('east')} AS x1, {_Y.format('south')} AS y0, {_Y.format('north')} AS y1 FROM box)",
    "pp": f"SELECT c_custkey, value, ({_X.format('lng')} - x0) / (x1 - x0) * {WIDTH} AS x, (1 - ({_Y.format('lat')} - y0) / (y1 - y0)) * h AS y FROM pts, fr",
    "ra": f"""SELECT px, py, sum(value * (1 - sqrt(dx * dx + dy * dy) / {RADIUS})) AS v FROM (SELECT CAST(floor(x) AS BIGINT) + dx AS px, CAST(floor(y) AS BIGINT) + dy AS py, dx, dy, value, h
        FROM pp, fr, range({-RADIUS}, {RADIUS + 1}) AS a(dx), range({-RADIUS}, {RADIUS + 1}) AS b(dy)) WHERE dx * dx + dy * dy <= {RADIUS * RADIUS} AND px >= 0 AND px < {WIDTH} AND py >= 0 AND py < h GROUP BY ALL""",
}
EDGES = {
    "vp": f"SELECT i, ({_X.format('lng')} - x0) / (x1 - x0) * {WIDTH} AS x, (1 - ({_Y.format('lat')} - y0) / (y1 - y0)) * h AS y FROM vert, fr",
    "ed": "SELECT a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM vp a JOIN vp b ON b.i = (a.i + 1) % (SELECT count(*) FROM vp)",
    "ins": """SELECT px, py, v FROM ra, ed WHERE least(ya, yb) <= py + 0.5 AND py + 0.5 < greatest(ya, yb) AND xa + (py + 0.5 - ya) * (xb - xa) / (yb - ya) > px + 0.5
        GROUP BY px, py, v HAVING count(*) % 2 = 1""",
}
_NORM = "v / (SELECT max(v) FROM ra)"


def vertices(t: Tables) -> DataFrame:
    radius, angle = 2.0 + F.col("n_regionkey") % 2, 2 * math.pi * F.col("n_nationkey") / 25
    return t.nation.select(
        F.lit(0).alias("poly_id"), F.lit(0).alias("ring_id"), F.col("n_nationkey").alias("i"), (10 + radius * F.cos(angle)).alias("lng"), (50 + radius * F.sin(angle)).alias("lat")
    )


def points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", (48 + (k * 7919 % 1000) / 250).alias("lat"), (8 + (k * 104729 % 1000) / 250).alias("lng"), (F.abs("c_acctbal") / 1000).alias("value")
    )


@query("g1_bounding_box", sql("SELECT round(south, 6) AS south, round(west, 6) AS west, round(north, 6) AS north, round(east, 6) AS east FROM box", **{k: CANVAS[k] for k in ("vert", "box")}))
def g1(t: Tables) -> DataFrame:
    v = vertices(t)
    rings = v.groupBy("poly_id").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("i", "lng", "lat"))), lambda p: F.array(p["lng"], p["lat"]))).alias("rings"))
    return rounded(raster.bounding_box(raster.ring_vertices(rings)), ["south", "west", "north", "east"])


@query("g2_pixel_mapping", sql("SELECT c_custkey, round(x, 6) AS x, round(y, 6) AS y FROM pp", **{k: v for k, v in CANVAS.items() if k != "ra"}))
def g2(t: Tables) -> DataFrame:
    return rounded(raster.to_pixels(points(t), frame_for(vertices(t), WIDTH)).select("c_custkey", "x", "y"), ["x", "y"])


@query("g3_density_raster", sql("SELECT px, py, round(v, 6) AS intensity FROM ra", **CANVAS))
def g3(t: Tables) -> DataFrame:
    return rounded(raster.density_raster(points(t), frame_for(vertices(t), WIDTH), RADIUS), ["intensity"])


@query("g4_colour_ramp", sql(f"""SELECT px, py, round(n0, 6) AS norm, CAST(CASE WHEN n < 0.5 THEN floor(255 * (n / 0.5::DOUBLE) + 0.5) ELSE 255 END AS INT) AS r,
    CAST(CASE WHEN n < 0.5 THEN 255 ELSE floor(255 * (1 - (n - 0.5) / 0.5::DOUBLE) + 0.5) END AS INT) AS g, 0 AS b FROM (SELECT px, py, {_NORM} AS n0, round({_NORM}, 9) AS n FROM ra)""", **CANVAS))
def g4(t: Tables) -> DataFrame:
    out = raster.coloured(raster.density_raster(points(t), frame_for(vertices(t), WIDTH), RADIUS))
    red, green, blue = geo.ramp(r("norm", 9))
    return out.select("px", "py", r("norm").alias("norm"), red.alias("r"), green.alias("g"), blue.alias("b"))


@query("g5_polygon_mask", sql("SELECT px, py, round(v, 6) AS intensity FROM ins", **CANVAS, **EDGES))
def g5(t: Tables) -> DataFrame:
    frame = frame_for(vertices(t), WIDTH)
    cells = raster.density_raster(points(t), frame, RADIUS)
    return rounded(raster.mask_polygon(cells, vertices(t), frame), ["intensity"])


@query("g6_zoom_intensity", "SELECT c_custkey, round(abs(c_acctbal) / 1000 / pow(2, (c_custkey % 13) / 6), 6) AS v FROM customer")
def g6(t: Tables) -> DataFrame:
    return points(t).select("c_custkey", r(geo.zoom_scaled("value", F.col("c_custkey") % 13)).alias("v"))


@query("g_heatmap", sql(f"SELECT px, py, round({_NORM}, 6) AS norm FROM ins", **CANVAS, **EDGES))
def g_all(t: Tables) -> DataFrame:
    return heatmap(points(t), vertices(t), WIDTH, RADIUS).select("px", "py", r("norm").alias("norm"))
