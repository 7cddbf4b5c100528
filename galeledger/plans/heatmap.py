"""Masked, coloured density raster of weighted points."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.raster import CANVAS_WIDTH_PX, KERNEL_RADIUS_PX, bounding_box, coloured, density_raster, frame_of, mask_polygon


def frame_for(vertices: DataFrame, width: int = CANVAS_WIDTH_PX) -> dict:
    """Canvas frame of a polygon; fetches its four bounds."""
    b = bounding_box(vertices).first()
    return frame_of(b["south"], b["west"], b["north"], b["east"], width)


def heatmap(points: DataFrame, vertices: DataFrame, width: int = CANVAS_WIDTH_PX, radius: int = KERNEL_RADIUS_PX) -> DataFrame:
    """(px, py, intensity, norm, r, g, b) inside the polygon. Normalised before masking."""
    frame = frame_for(vertices, width)
    return mask_polygon(coloured(density_raster(points, frame, radius)), vertices, frame)
