"""Bilinear interpolation of a gridded table at arbitrary sites.

A cell of the grid at one time is one row with its four corners, made once for the cells that hold
sites. A site meets the rows of its cell and is blended inside the row, so rows of site and time are
never shuffled. Nodes are integer indices; coordinates are never compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

CORNERS = [(0, 0), (0, 1), (1, 0), (1, 1)]
CELL = ["cell_lat", "cell_lon"]


def site_cells(sites: DataFrame, site_keys: Sequence[str], step: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(site, cell, w0..w3): the cell a site lies in and the weights of its corners, in the order of ``CORNERS``."""
    y, x = F.col(lat) / step, F.col(lon) / step
    fy, fx = y - F.floor(y), x - F.floor(x)
    weights = [(fy if dy else 1 - fy) * (fx if dx else 1 - fx) for dy, dx in CORNERS]
    return sites.select(
        *site_keys, F.floor(y).cast("int").alias("cell_lat"), F.floor(x).cast("int").alias("cell_lon"), *[w.alias(f"w{k}") for k, w in enumerate(weights)],
    ).where("cell_lat is not null and cell_lon is not null")


def with_grid_index(grid: DataFrame, step: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return grid.withColumn("lat_i", F.round(F.col(lat) / step).cast("int")).withColumn(
        "lon_i", F.round(F.col(lon) / step).cast("int")
    )


def cell_corners(grid: DataFrame, cells: DataFrame, variables: Sequence[str], time: str = "time") -> DataFrame:
    """(cell, time, c0..c3): the variables at the four corners of every wanted cell, NULL where the grid has no such node.

    Every node is a corner of four cells; copies for cells without sites are dropped before the shuffle.
    """
    copies = F.explode(F.array(*[
        F.struct((F.col("lat_i") - dy).alias("cell_lat"), (F.col("lon_i") - dx).alias("cell_lon"), F.lit(k).alias("k")) for k, (dy, dx) in enumerate(CORNERS)
    ]))
    node = F.struct(*[F.col(v) for v in variables])
    shifted = grid.select(time, node.alias("_node"), copies.alias("_c")).select(time, "_node", "_c.*").join(cells.select(*CELL).distinct(), CELL, "left_semi")
    return shifted.groupBy(*CELL, time).agg(*[F.max(F.when(F.col("k") == k, F.col("_node"))).alias(f"c{k}") for k in range(len(CORNERS))])


def interpolate_grid(
    sites: DataFrame, grid: DataFrame, site_keys: Sequence[str], variables: Sequence[str], step: float, time: str = "time",
) -> DataFrame:
    """Value of every variable at every (site, time). NULL when a needed node is
    outside the grid or unknown, as a lone missing corner makes the blend unknown;
    no row where the grid has none of them. Corners of weight zero are not needed.

    ``grid`` carries integer ``lat_i``/``lon_i``, one row per node and time; site columns other than the keys
    are re-attached by the caller.
    """
    placed = site_cells(sites, site_keys, step)
    rows = cell_corners(grid, placed, variables, time).join(placed, CELL)
    corners = range(len(CORNERS))
    needed = [F.col(f"w{k}") > 0 for k in corners]
    some = reduce(lambda a, b: a | b, [needed[k] & F.col(f"c{k}").isNotNull() for k in corners])

    def blend(v: str):
        parts = [F.when(needed[k], F.col(f"w{k}") * F.col(f"c{k}")[v]).otherwise(F.lit(0.0)) for k in corners]
        return reduce(lambda a, b: a + b, parts).alias(v)

    return rows.where(some).select(*site_keys, time, *[blend(v) for v in variables])
