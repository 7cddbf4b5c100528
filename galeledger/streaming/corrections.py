"""Live telemetry whose samples may be late, repeated or corrected: an hour is closed by a timer per turbine and hour."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.calendar import from_micros, micros
from ..operators.aggregate import hourly_measures, keep_available_hours
from ..session import importable

HOUR = 3_600_000_000  # microseconds
SAMPLE = ["version", "power_kw", "wind_speed_ms", "is_available"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class HourOfTurbine(StatefulProcessor):
    """Keeps the last version of every sample of one (turbine, hour) and emits the hour when its timer fires.

    State is one entry per time of a sample, however often the sample is sent.
    """

    def __init__(self, names: Sequence[str]):
        self.names = list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getMapState("samples", "place long", "version long, power_kw double, wind_speed_ms double, is_available boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            last = pdf.sort_values("version", kind="stable").drop_duplicates("place", keep="last")
            for r in last.itertuples(index=False):
                at = (int(r.place),)
                held = self.samples.getValue(at) if self.samples.containsKey(at) else None
                if held is None or held[0] <= r.version:
                    self.samples.updateValue(at, (int(r.version), *(None if pd.isna(v) else v for v in (r.power_kw, r.wind_speed_ms, r.is_available))))
        self.handle.registerTimer((int(key[-1]) + HOUR) // 1000)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(v) for _, v in self.samples.iterator()], columns=SAMPLE)
        self.samples.clear()
        known = lambda c: held[c].dropna().astype(float)
        power = known("power_kw")
        yield pd.DataFrame([[*key, known("is_available").mean(), power.sum() / 6.0 if len(power) else None, known("wind_speed_ms").mean()]],
                           columns=[*self.names, "hour", "availability_fraction", "energy_kwh", "wind_speed_ms"])

    def close(self) -> None:
        pass


def corrected_hours(rows: DataFrame, keys: Sequence[str], version: str, time: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Stream of (keys, ts, availability_fraction, energy_kwh, wind_speed_ms), each hour once, when the watermark passes its end.

    Of samples of one turbine and time the one of the greatest ``version`` counts, and of equal versions the last that arrived. The watermark is that of hours, so a sample may come
    late, again or corrected until its hour closes; then it is dropped.
    """
    spark = importable(rows.sparkSession)
    hour = F.floor(micros(time) / HOUR) * HOUR
    placed = rows.select(
        *keys, hour.cast("long").alias("hour"), (micros(time) - hour).cast("long").alias("place"), F.col(version).cast("long").alias("version"),
        "power_kw", "wind_speed_ms", "is_available", F.timestamp_micros(hour + HOUR).alias("hour_end"),
    ).withWatermark("hour_end", delay)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, hour long, availability_fraction double, energy_kwh double, wind_speed_ms double"
    spark.conf.set(PROVIDER, ROCKS)  # map state and timers need it; read when the stream starts
    hours = placed.groupBy(*keys, "hour").transformWithStateInPandas(HourOfTurbine(keys), schema, "append", "eventTime")
    return keep_available_hours(hours.select(*keys, from_micros("hour").alias("ts"), "availability_fraction", "energy_kwh", "wind_speed_ms"))


def open_hours(spark: SparkSession, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Hours that a stopped stream still holds, rolled up as if their input ended: the last hours of a finite input.

    They are read from the state of the checkpoint, which stays as it is: when the stream goes on, it emits them itself.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "samples").load()
    rows = state.select(*[F.col("key")[k].alias(k) for k in keys], from_micros(F.col("key")["hour"]).alias("ts"), "user_map_value.*")
    return keep_available_hours(rows.groupBy(*keys, "ts").agg(*hourly_measures()))


def write_corrected(hours: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed hours to Parquet over everything that is available now; a restart with the same checkpoint goes on."""
    return (
        hours.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
