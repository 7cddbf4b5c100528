"""Interval (theta) join by sweep line.

Each ``[start, end)`` interval becomes two events on the tick grid, +1 at the
first tick inside and -1 at the first tick past the end. Summing events per
tick and running the sum gives the number of open intervals, whatever their
length or overlap: the work is linear in intervals plus ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import ceil_to
from .ordered import DAY, running_total_raw


def open_interval_count(
    ticks: DataFrame, intervals: DataFrame, keys: Sequence[str], start: str, end: str,
    tick_minutes: int, time: str = "ts", name: str = "n_open", slice_seconds: int = 30 * DAY,
) -> DataFrame:
    """Number of intervals with start <= tick < end, for every row of ``ticks``.

    ``ticks`` must lie on the ``tick_minutes`` grid and be unique per key.
    """
    live = intervals.where(F.col(start) < F.col(end))
    edges = live.select(*keys, F.explode(F.array(
        F.struct(ceil_to(start, tick_minutes).alias(time), F.lit(1).alias("_d")),
        F.struct(ceil_to(end, tick_minutes).alias(time), F.lit(-1).alias("_d")),
    )).alias("_e")).select(*keys, f"_e.{time}", "_e._d")
    steps = edges.groupBy(*keys, time).agg(F.sum("_d").alias("_d")).withColumn("_tick", F.lit(False))
    marks = ticks.withColumn("_d", F.lit(0).cast("bigint")).withColumn("_tick", F.lit(True))
    both = marks.unionByName(steps, allowMissingColumns=True)
    return running_total_raw(both, keys, time, "_d", name, slice_seconds).where("_tick").drop("_tick", "_d")
