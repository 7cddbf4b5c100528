"""Order-dependent operators on keyed rows.

Two shapes of input occur. A *calendar* table has one row per key and period, so
a key can never hold more rows than the calendar has periods and a plain window
per key is safe. A *raw* table (telemetry, events) can put a third of all rows
on one key; there the window runs per (key, time slice) and the little that
crosses slice borders is carried through a table with one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import micros

DAY = 86_400

Keys = Sequence[str]


def _cols(keys: Keys) -> list[Column]:
    return [F.col(k) for k in keys]


def time_slice(c, seconds: int) -> Column:
    return F.floor(micros(c) / (seconds * 1_000_000)).cast("bigint")


def keep_last(df: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``.

    An aggregate rather than a ranked window, so copies collapse on the map side
    and a key with very many copies never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def first_rows(df: DataFrame, keys: Keys, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark trims to ``n`` per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def last_rows(df: DataFrame, keys: Keys, time: str, n: int) -> DataFrame:
    return first_rows(df, keys, [F.desc(time)], n)


def trailing_mean(df: DataFrame, keys: Keys, time: str, value: str, n: int, name: str = "level") -> DataFrame:
    """Mean of the last ``n`` rows of each key."""
    return last_rows(df, keys, time, n).groupBy(*keys).agg(F.avg(value).alias(name))


# --- calendar tables: plain windows -----------------------------------------

def lag_row(value: str, keys: Keys, time: str) -> Column:
    """Previous row of the same key. By row, not by month: a gap shifts silently,
    use :func:`month_gaps` to detect one."""
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(time))


def month_gaps(df: DataFrame, keys: Keys, month: str) -> DataFrame:
    """Months whose predecessor row is more than one month earlier."""
    w = Window.partitionBy(*keys).orderBy(month)
    step = (F.year(month) * 12 + F.month(month)) - F.lag(F.year(month) * 12 + F.month(month)).over(w)
    return df.withColumn("gap_months", step - 1).where(F.col("gap_months") > 0)


def rolling_mean(value: str, keys: Keys, time: str, n: int) -> Column:
    """Mean of the current and the ``n - 1`` rows before it (fewer at the start)."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(time).rowsBetween(-(n - 1), 0))


def filled(value: str, keys: Keys, time: str, backward: bool = True) -> Column:
    """Forward fill, then (optionally) backward fill the rows before the first value.

    The backward part takes the key's earliest known value, which is the same
    row a backward scan would find and needs no second sort.
    """
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    forward = F.last(value, ignorenulls=True).over(w)
    if not backward:
        return forward
    earliest = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(time))).over(Window.partitionBy(*keys))
    return F.coalesce(forward, earliest)


def monthly_steps(df: DataFrame, keys: Keys, month: str, values: Sequence[str], until: Column) -> DataFrame:
    """Dense monthly form of a sparse calendar table: each row repeats every month until
    the next row, the last one through ``until``. An equi-join with it is an as-of
    backward join on months. Rows with an unknown value are removed first.
    """
    w = Window.partitionBy(*keys).orderBy(month)
    last = F.coalesce(F.add_months(F.lead(month).over(w), -1), F.greatest(F.col(month), until))
    known = df.na.drop(subset=list(values)).withColumn("_last", last)
    return known.withColumn(month, F.explode(F.sequence(month, "_last", F.expr("interval 1 month")))).drop("_last")


def row_trend(keys: Keys, time: str) -> Column:
    """0, 1, 2, ... in time order."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1


# --- raw tables: windows per time slice, with carry --------------------------

#
# The rows pass one exchange, by (key, slice). The carry table is aggregated straight
# from the input on the map side: a second, narrow scan instead of a second shuffle.

def sliced(df: DataFrame, time: str, seconds: int) -> DataFrame:
    return df.withColumn("_slice", time_slice(time, seconds))


def _carried(rows: DataFrame, carry: DataFrame, keys: Keys) -> DataFrame:
    """Each row with its slice's carry; NULL keys meet like any other."""
    named = carry.withColumnsRenamed({k: f"_on_{i}" for i, k in enumerate([*keys, "_slice"])})
    on = [rows[k].eqNullSafe(named[f"_on_{i}"]) for i, k in enumerate([*keys, "_slice"])]
    return rows.join(named, on).drop(*[f"_on_{i}" for i in range(len(keys) + 1)])


def _with_untimed(out: DataFrame, df: DataFrame, time: str) -> DataFrame:
    """Rows without a time have no place in the order: they stay, with a NULL result."""
    return out.unionByName(df.where(F.col(time).isNull()), allowMissingColumns=True)


def lag_raw(df: DataFrame, keys: Keys, time: str, value: str, name: str, seconds: int = DAY) -> DataFrame:
    """Previous value per key on a raw table of any per-key size; NULL keys form a group, NULL times get NULL."""
    rows = sliced(df.where(F.col(time).isNotNull()), time, seconds)
    per_slice = Window.partitionBy(*keys, "_slice").orderBy(time, value)
    # The plain maximum hashes; only a value beside the time needs the ordered pair.
    last = F.max(time) if value == time else F.max(F.struct(F.col(time).alias("_t"), F.col(value).alias("_v"))).getField("_v")
    ends = rows.groupBy(*keys, "_slice").agg(last.alias("_end"))
    carry = ends.select(*keys, "_slice", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry"))
    here = rows.withColumn("_rn", F.row_number().over(per_slice)).withColumn("_prev", F.lag(value).over(per_slice))
    out = _carried(here, carry, keys).withColumn(name, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev")))
    return _with_untimed(out.drop("_slice", "_rn", "_prev", "_carry"), df, time)


def running_total_raw(df: DataFrame, keys: Keys, time: str, value: str, name: str, seconds: int = DAY) -> DataFrame:
    """Running sum per key up to and including all rows at the same time; NULL keys form a group, NULL times get NULL."""
    rows = sliced(df.where(F.col(time).isNotNull()), time, seconds)
    sums = rows.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum"))
    before = sums.select(
        *keys, "_slice",
        F.coalesce(
            F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
    )
    upto = Window.partitionBy(*keys, "_slice").orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    out = _carried(rows.withColumn("_within", F.sum(value).over(upto)), before, keys)
    out = out.withColumn(name, F.col("_before") + F.coalesce(F.col("_within"), F.lit(0)))
    return _with_untimed(out.drop("_slice", "_within", "_before"), df, time)


def row_number_raw(df: DataFrame, keys: Keys, time: str, name: str, tie: Sequence[str] = (), seconds: int = DAY) -> DataFrame:
    """0-based position per key on a raw table; NULL keys form a group, NULL times get NULL."""
    rows = sliced(df.where(F.col(time).isNotNull()), time, seconds)
    sizes = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        *keys, "_slice",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
    )
    w = Window.partitionBy(*keys, "_slice").orderBy(time, *tie)
    out = _carried(rows.withColumn("_rn", F.row_number().over(w)), before, keys).withColumn(name, F.col("_before") + F.col("_rn") - 1)
    return _with_untimed(out.drop("_slice", "_rn", "_before"), df, time)
