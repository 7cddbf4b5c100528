"""As-of joins, composed from windows over (key, time slice).

By default only the distinct probe times and the value rows travel through the sort;
the full left rows meet the resolved values in a plain equi-join afterwards, which
adaptive execution can broadcast or split when one probe time is very frequent. Where
the caller knows that a left row is unique per key and time (``unique=True``), the rows
themselves travel through the sort and the second shuffle is saved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import micros
from .ordered import DAY, keep_last

_VALUE_SIDE, _PROBE_SIDE = 0, 1


def _probes(left: DataFrame, keys: Sequence[str], time: str, unique: bool) -> DataFrame:
    timed = left.where(F.col(time).isNotNull())
    if unique:
        return timed.select(*keys, micros(time).alias("_t"), F.struct(*left.columns).alias("_row"))
    return timed.select(*keys, micros(time).alias("_t")).distinct()


def _value_rows(right: DataFrame, keys, time, values, tie) -> DataFrame:
    """One value row per (key, time): the last by ``tie``, else the greatest."""
    rows = right.where(F.col(time).isNotNull()).select(*keys, micros(time).alias("_t"), *values, *[c for c in tie if c not in values])
    if not tie and len(values) == 1:
        return rows.groupBy(*keys, "_t").agg(F.max(values[0]).alias(values[0]))  # hashes, where an ordered pair would sort
    return keep_last(rows, [*keys, "_t"], list(tie) or list(values)).select(*keys, "_t", *values)


def _reattach(left: DataFrame, resolved: DataFrame, keys, time, values, unique) -> DataFrame:
    """Left rows with the values of the struct ``_hit``."""
    if unique:
        timed = resolved.select("_row.*", *[F.col(f"_hit.{v}").alias(v) for v in values])
        return timed.unionByName(left.where(F.col(time).isNull()), allowMissingColumns=True)
    resolved = resolved.select(*keys, "_t", *[F.col(f"_hit.{v}").alias(v) for v in values])
    # Rename before joining so that the two sides never share a column name.
    found = resolved.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_t").alias("_tk"), *values)
    on = [left[k].eqNullSafe(found[f"_k{i}"]) for i, k in enumerate(keys)]
    on.append(micros(left[time]) == found["_tk"])
    return left.join(found, on, "left").select(*[left[c] for c in left.columns], *[found[v] for v in values])


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str],
    right_time: str | None = None, tie: Sequence[str] = (), slice_seconds: int = 30 * DAY, unique: bool = False,
) -> DataFrame:
    """Latest right values at or before each left time; unknown values are removed first."""
    right = right.na.drop(subset=list(values))
    both = (
        _value_rows(right, keys, right_time or time, values, tie).withColumn("_side", F.lit(_VALUE_SIDE))
        .unionByName(_probes(left, keys, time, unique).withColumn("_side", F.lit(_PROBE_SIDE)), allowMissingColumns=True)
        .withColumn("_slice", F.floor(F.col("_t") / (slice_seconds * 1_000_000)))
    )
    # One row per slice: its own latest values (times are unique per key, so the columns
    # agree on the row), then the latest of all earlier slices.
    value_time = F.when(F.col("_side") == _VALUE_SIDE, F.col("_t"))
    ends = both.groupBy(*keys, "_slice").agg(F.max(value_time).alias("_vt"), *[F.max_by(v, value_time).alias(v) for v in values])
    own = ends.select(*keys, "_slice", F.when(F.col("_vt").isNotNull(), F.struct(*values)).alias("_own"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = own.select(*keys, "_slice", F.last("_own", ignorenulls=True).over(earlier).alias("_carry"))
    here = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    mine = F.when(F.col("_side") == _VALUE_SIDE, F.struct(*values))
    asked = both.withColumn("_here", F.last(mine, ignorenulls=True).over(here)).where(F.col("_side") == _PROBE_SIDE)
    # Null-safe, like the windows: a NULL key is a key.
    named = carry.withColumnsRenamed({k: f"_on_{i}" for i, k in enumerate([*keys, "_slice"])})
    on = [asked[k].eqNullSafe(named[f"_on_{i}"]) for i, k in enumerate([*keys, "_slice"])]
    resolved = asked.join(named, on, "left").withColumn("_hit", F.coalesce("_here", "_carry"))
    return _reattach(left, resolved, keys, time, values, unique)


def asof_nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str],
    tolerance_seconds: int, right_time: str | None = None, tie: Sequence[str] = (), slice_seconds: int = DAY,
    unique: bool = False,
) -> DataFrame:
    """Closest right row within an inclusive tolerance; the earlier row wins a tie.

    A value row is copied to the neighbouring slice only when it lies within the
    tolerance of the border, so slices are independent and no carry is needed.
    """
    tol, width = tolerance_seconds * 1_000_000, max(slice_seconds, 2 * tolerance_seconds) * 1_000_000
    feed = _value_rows(right, keys, right_time or time, values, tie).withColumn(
        "_slice", F.explode(F.sequence(F.floor((F.col("_t") - tol) / width), F.floor((F.col("_t") + tol) / width)))
    )
    asks = _probes(left, keys, time, unique).withColumn("_slice", F.floor(F.col("_t") / width))
    both = feed.withColumn("_side", F.lit(_VALUE_SIDE)).unionByName(
        asks.withColumn("_side", F.lit(_PROBE_SIDE)), allowMissingColumns=True
    )
    both = both.select(
        *keys, "_slice", "_t", "_side", *(["_row"] if unique else []), F.when(F.col("_side") == _VALUE_SIDE, F.struct(F.col("_t").alias("_vt"), *values)).alias("_vals")
    )
    part = Window.partitionBy(*keys, "_slice")
    upto = Window.unboundedPreceding, 0
    before = F.last("_vals", ignorenulls=True).over(part.orderBy("_t", "_side").rowsBetween(*upto))
    # Descending scan: at equal time the probe comes first, so an exact hit is found only once.
    after = F.last("_vals", ignorenulls=True).over(part.orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(*upto))
    gap_before = F.col("_t") - F.col("_before._vt")
    gap_after = F.col("_after._vt") - F.col("_t")
    hit = F.when((gap_before <= tol) & (gap_after.isNull() | (gap_before <= gap_after)), F.col("_before")).when(
        gap_after <= tol, F.col("_after")
    )
    resolved = (
        both.withColumn("_before", before).withColumn("_after", after)
        .where(F.col("_side") == _PROBE_SIDE)
        .withColumn("_hit", hit)
    )
    return _reattach(left, resolved, keys, time, values, unique)
