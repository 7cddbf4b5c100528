"""Live telemetry to hourly energy, with the same measures as the batch roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import hourly_measures, keep_available_hours


def stream_hourly(rows: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "2 hours") -> DataFrame:
    """An hour is emitted once, when the watermark passes its end; later rows are dropped."""
    hours = rows.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("_w"), *keys).agg(*hourly_measures())
    flat = hours.select(*keys, F.col("_w.start").alias("ts"), "availability_fraction", "energy_kwh", "wind_speed_ms")
    return keep_available_hours(flat)


def write_hours(hours: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet over everything that is available now. Restarting with the
    same checkpoint continues where the last run ended."""
    return (
        hours.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
