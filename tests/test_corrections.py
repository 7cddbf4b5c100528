"""The stream with corrections equals the batch roll-up of the last versions."""

import datetime as dt
import random

import pytest

from galeledger.operators import aggregate
from galeledger.streaming.corrections import PROVIDER, corrected_hours, open_hours, write_corrected

SCHEMA = "turbine_id string, ts timestamp, version long, power_kw double, wind_speed_ms double, is_available boolean"
T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_with_corrections_equals_batch(spark, tmp_path, shuffled):
    rng = random.Random(5)
    before = spark.conf.get(PROVIDER)
    batches = []
    for b in range(4):
        rows = []
        for turbine in "ab":
            for i in range(60):  # ten hours of samples a file; the last two hours come again, corrected, in the next file
                at = T0 + dt.timedelta(minutes=10 * (60 * b + i))
                rows.append((turbine, at, 2 * b, rng.choice([None, 5.0, 60.0]), rng.choice([None, 4.0]), rng.random() < 0.8))
                if rng.random() < 0.3:
                    rows.append((*rows[-1][:2], 2 * b + 1, rng.random() * 9, 6.0, True))
            if b:
                for i in range(48, 60):
                    rows.append((turbine, T0 + dt.timedelta(minutes=10 * (60 * (b - 1) + i)), 2 * b, 30.0 + i, 9.0, i % 5 > 0))
        if shuffled:
            rng.shuffle(rows)
        batches.append(rows)
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    try:
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(SCHEMA).parquet(src)
            write_corrected(corrected_hours(stream, ["turbine_id"], "version", delay="13 hours"), out, state).awaitTermination()
        last = {}
        for r in sorted((r for rows in batches for r in rows), key=lambda r: r[2]):
            last[r[0], r[1]] = r
        want = aggregate.telemetry_hourly(spark.createDataFrame(list(last.values()), SCHEMA), ["turbine_id"])
        closed = spark.read.schema("turbine_id string, ts timestamp_ntz, availability_fraction double, energy_kwh double, wind_speed_ms double").parquet(out)
        still = open_hours(spark, state, ["turbine_id"])
        shown = lambda df: sorted((r.turbine_id, r.ts, *(round(r[c], 9) for c in ("availability_fraction", "energy_kwh", "wind_speed_ms"))) for r in df.collect())
        assert closed.count() > 10 and still.count() > 5
        assert shown(closed.unionByName(still.select(*closed.columns))) == shown(want)
    finally:
        spark.conf.set(PROVIDER, before)
