"""Exact quantiles, linear-interpolated.

``F.percentile`` is right for groups the calendar or a parameter bounds (months
of a series, simulations of a month). For raw groups of any size it would hold
every distinct value of the group in one task; :func:`exact_quantiles` narrows the wanted
ranks down by histograms instead and still returns the exact answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

PER_FOLD = 256  # first buckets while a value grows by the factor e
PARTS = 1 << 16  # buckets of a stretch that is cut again
STRETCH = 1 << 20  # rows of a stretch that are ranked value by value


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _counted(rows: DataFrame, by: Sequence[str], bucket: Column, *carried: Column) -> DataFrame:
    """Rows, least and greatest value per bucket; a bucket never falls as the value rises."""
    return rows.groupBy(*by, bucket.alias("_b")).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *carried)


def _stretches(counts: DataFrame, keys: Sequence[str], by: Sequence[str], ranks: Column) -> DataFrame:
    """Buckets that hold a wanted rank: (keys, _n, _lo, _hi, _want), the ranks counted within the bucket."""
    placed = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    hits = F.filter(F.transform(ranks, lambda r: r.withField("rank", r["rank"] - F.col("_before"))), lambda r: (r["rank"] >= 0) & (r["rank"] < F.col("_n")))
    return placed.withColumn("_want", hits).where(F.size("_want") > 0).select(*keys, "_n", "_lo", "_hi", "_want")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (name -> probability).

    ``weight`` is an integer number of copies per row, for data whose copies are
    already combined. NULL values are left out, NaN lies above all; a NULL key is a key.

    One pass counts rows by buckets on a logarithmic scale, and each wanted rank falls into one of them. A bucket of more than
    2^20 rows and several values is cut again into 2^16 parts, as often as needed; then the values of the hit buckets, and of no others, are ranked.
    Counts are combined before the shuffle, so neither a hot key nor a hot value gathers rows, whatever the size of a group. ``df`` is
    read twice, and once more for each further cut.
    """
    keys = list(keys)
    copies = F.lit(1) if weight is None else F.col(weight)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), copies.cast("bigint").alias("_w"))
    far = F.lit(1 << 62).cast("bigint")
    scale = F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * PER_FOLD).cast("bigint")
    first = F.when(F.isnan("_v"), far + 1).when(F.abs("_v") == float("inf"), F.signum("_v").cast("bigint") * far).otherwise(scale)
    counts = settle(_counted(rows, keys, first), "quantile-counts")
    # Wanted places: the row below and the row above each probability's position among all rows of the key.
    place = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil if up else F.floor)(place(p)).alias("rank"), F.col("_total").alias("total"))
                      for i, p in enumerate(probs.values()) for up in (False, True)])
    want = settle(_stretches(counts.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))), keys, keys, ranks), "quantile-ranks")

    def within(stretches: DataFrame, bucket: Column) -> DataFrame:
        spans = stretches.select(*keys, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_want")
        found = rows.alias("r").join(spans.alias("s"), _same(keys, "r", "s") & F.col("r._v").between(F.col("s._from"), F.col("s._to"))).select("r.*", "s._from", "s._to", "s._want")
        return _stretches(_counted(found, [*keys, "_from"], bucket, F.first("_want").alias("_ranks")), keys, [*keys, "_from"], F.col("_ranks"))

    wide = (F.col("_n") > STRETCH) & (F.col("_lo") < F.col("_hi"))
    while not want.where(wide).isEmpty():
        part = F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * PARTS)
        want = settle(want.where(~wide).unionByName(within(want.where(wide), part)), "quantile-ranks")
    found = within(want, F.col("_v")).select(*keys, "_lo", F.explode("_want").alias("_r"))
    at = lambda i, up: F.max(F.when((F.col("_r.i") == i) & (F.col("_r.up") == up), F.col("_lo")))
    found = found.groupBy(*keys).agg(F.max("_r.total").alias("_total"), *[at(i, up).alias(f"_{'hi' if up else 'lo'}_{i}") for i in range(len(probs)) for up in (False, True)])
    out = []
    for i, (name, p) in enumerate(probs.items()):
        lo, hi = F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place(p) - F.floor(place(p)))).alias(name))
    return found.select(*keys, *out)
