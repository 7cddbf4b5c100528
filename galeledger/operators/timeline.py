"""Spines, horizons and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import spread
from ..functions.calendar import ceil_to, floor_to, from_micros, hour_start, micros, month_start, quarter_start

TEN_MINUTES = 10
FULL_AVAILABILITY_SHARE = 2.0 / 3.0


def month_horizon(df: DataFrame, start, n, name: str = "month") -> DataFrame:
    """``n`` consecutive month starts per row, beginning at column ``start``."""
    start = F.col(start) if isinstance(start, str) else start
    n = n if isinstance(n, Column) else F.lit(int(n))
    return df.withColumn(name, F.explode(F.sequence(start, F.add_months(start, n - 1), F.expr("interval 1 month"))))


def quarter_horizon(df: DataFrame, start, end, name: str = "quarter") -> DataFrame:
    """Every quarter start from ``start`` to ``end`` inclusive, per row."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return df.withColumn(name, F.explode(F.sequence(start, end, F.expr("interval 3 month"))))


def months_of_quarter(quarter) -> Column:
    quarter = F.col(quarter) if isinstance(quarter, str) else quarter
    return F.sequence(quarter, F.add_months(quarter, 2), F.expr("interval 1 month"))


def quarter_to_months(df: DataFrame, keys: Sequence[str], quarter: str, value: str, how: str, order: str | None = None) -> DataFrame:
    """Three months per quarter: ``mean`` repeats a rate, ``split`` divides a volume
    by three and sums, ``first`` repeats and keeps the first copy by ``order``."""
    rows = df.na.drop(subset=[quarter, value]).withColumn("month", F.explode(months_of_quarter(quarter_start(quarter))))
    grouped = rows.groupBy(*keys, "month")
    if how == "mean":
        return grouped.agg(F.avg(value).alias(value))
    if how == "split":
        return grouped.agg((F.sum(F.col(value) / 3.0)).alias(value))
    if how == "first":
        return grouped.agg(F.min_by(value, order or quarter).alias(value))
    raise ValueError(f"how must be mean, split or first, not {how!r}")


def ten_minute_timeline(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Regular ticks per key from floor(min start) to ceil(max end)."""
    span = df.groupBy(*keys).agg(
        floor_to(F.min(start), TEN_MINUTES).alias("_a"), ceil_to(F.max(end), TEN_MINUTES).alias("_b")
    )
    return tick_rows(span, keys, "_a", "_b", TEN_MINUTES)


def tick_rows(span: DataFrame, keys: Sequence[str], start: str, end: str, minutes: int, name: str = "ts") -> DataFrame:
    """Ticks from ``start`` to ``end``. Days are exploded and spread first, so a
    long span does not come out of one task."""
    day, step = 86_400_000_000, minutes * 60_000_000
    a, b = micros(start), micros(end)
    days = span.select(*keys, a.alias("_a"), b.alias("_b"), F.explode(F.sequence(F.floor(a / day), F.floor(b / day))).alias("_day"))
    wide = spread(days, *keys, "_day")
    lo = F.greatest(F.col("_a"), F.col("_day") * day + F.pmod(F.col("_a") - F.col("_day") * day, F.lit(step)))
    hi = F.least(F.col("_b"), (F.col("_day") + 1) * day - 1)
    ticks = wide.where(lo <= hi).select(*keys, F.explode(F.sequence(lo, hi, F.lit(step))).alias("_m"))
    return ticks.select(*keys, from_micros("_m").alias(name))


def hourly_dense(df: DataFrame, keys: Sequence[str], time: str, aggregates: dict[str, Column], defaults: dict[str, float]) -> DataFrame:
    """Hourly aggregate that also emits the empty hours between a key's first and last."""
    hourly = df.groupBy(*keys, hour_start(time).alias("ts")).agg(*[c.alias(n) for n, c in aggregates.items()])
    span = hourly.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    spine = tick_rows(span, keys, "_a", "_b", 60)
    out = spine.join(hourly, [*keys, "ts"], "left")
    return out.select(*keys, "ts", *[F.coalesce(F.col(n), F.lit(defaults[n])).alias(n) if n in defaults else F.col(n) for n in aggregates])


def monthly_if_complete(df: DataFrame, keys: Sequence[str], time: str, value: str, min_count: int = 24 * 28) -> DataFrame:
    """Month sums that exist only where at least ``min_count`` values are known."""
    return (
        df.groupBy(*keys, month_start(time).alias("month"))
        .agg(F.count(value).alias("_n"), F.sum(value).alias(value))
        .where(F.col("_n") >= min_count)
        .drop("_n")
    )
