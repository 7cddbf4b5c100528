"""Gridded climate as a long table: (time, latitude, longitude, variables...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expr import null_if_nan
from ..operators.checks import require_columns
from ..operators.grid import with_grid_index

REQUIRED = ["u10", "v10", "u100", "v100", "t2m", "sp"]
OPTIONAL = ["d2m", "fsr", "zust"]
AXES = ["time", "latitude", "longitude"]


def standard_grid(df: DataFrame) -> DataFrame:
    """``valid_time`` becomes ``time``; NaN becomes NULL; absent optional variables are NULL."""
    if "time" not in df.columns and "valid_time" in df.columns:
        df = df.withColumnRenamed("valid_time", "time")
    require_columns(df, AXES)
    known = [v for v in [*REQUIRED, *OPTIONAL] if v in df.columns]
    return df.select(*AXES, *[null_if_nan(F.col(v).cast("double")).alias(v) for v in known])


def read_grid(spark: SparkSession, paths: str | Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Many monthly files as one logical grid, from ``start`` up to before ``end`` (ISO dates) where given.

    Files written by :func:`write_grid` are pruned to the months of the span.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("mergeSchema", True).parquet(*listed)
    if "ym" in raw.columns:
        month = F.col("ym").cast("string")
        raw = raw.where(month >= start[:7]) if start else raw
        raw = raw.where(month <= end[:7]) if end else raw
    grid = standard_grid(raw)
    grid = grid.where(F.col("time") >= F.lit(start).cast("timestamp_ntz")) if start else grid
    return grid.where(F.col("time") < F.lit(end).cast("timestamp_ntz")) if end else grid


def write_grid(df: DataFrame, path: str) -> None:
    """Partitioned by month, so that a horizon prunes files."""
    df.withColumn("ym", F.date_format("time", "yyyy-MM")).write.partitionBy("ym").mode("overwrite").parquet(path)


def combine_grids(main: DataFrame, *others: DataFrame) -> DataFrame:
    """Outer join on the axes; a variable present on both sides is taken from the first.

    Nodes meet by their coordinates in ten-thousandths of a degree, so single- and double-precision
    files of one grid agree; the first side's coordinates are kept.
    """
    scaled = lambda c: F.round(F.col(c).cast("double") * 10_000).cast("long")
    nodes = {"_lat": scaled("latitude"), "_lon": scaled("longitude")}
    out = standard_grid(main).withColumns(nodes)
    for o in others:
        o = standard_grid(o).withColumns(nodes)
        extra = [c for c in o.columns if c not in out.columns]
        renamed = o.select("time", "_lat", "_lon", F.col("latitude").alias("_latitude"), F.col("longitude").alias("_longitude"), *extra)
        out = out.join(renamed, ["time", "_lat", "_lon"], "full_outer").withColumns(
            {"latitude": F.coalesce("latitude", "_latitude"), "longitude": F.coalesce("longitude", "_longitude")}).drop("_latitude", "_longitude")
    return out.drop("_lat", "_lon").select(*AXES, *[c for c in out.columns if c not in (*AXES, "_lat", "_lon")])


def indexed_grid(df: DataFrame, step: float) -> DataFrame:
    """Complete variable set with integer node indices, ready for interpolation."""
    require_columns(df, REQUIRED)
    for v in OPTIONAL:
        if v not in df.columns:
            df = df.withColumn(v, F.lit(None).cast("double"))
    return with_grid_index(df, step)
