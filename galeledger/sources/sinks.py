"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.expr import finite
from .ledger import append_new_keys


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV for export, one file per partition; the header repeats per file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_key(df: DataFrame, keys: Sequence[str], path: str, max_rows_per_file: int = 5_000_000) -> None:
    """One folder per key. Overwriting replaces only the keys present in ``df``.

    The rebalance hint brings a key's rows together so that small keys make one file,
    and lets adaptive execution split a very large key over many tasks.
    """
    (
        df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_rows_per_file).partitionBy(*keys).parquet(path)
    )


def json_safe(df: DataFrame) -> DataFrame:
    """Dates as text; NaN and infinities as NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_rows(df: DataFrame, name: str = "record") -> DataFrame:
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias(name))


def revenue_summary(monthly: DataFrame, keys: Sequence[str], tso: str = "tso") -> DataFrame:
    """(keys, metric, value as text): operator, support flag, first month, strike, total, yearly mean; NULL where unknown."""
    text = lambda c, n: F.when(c.isNotNull(), F.format_string(f"%.{n}f", c))
    # Text has no place in a hash aggregate: a maximum of it next to the sums would sort all months. So it is a key of the sums, and only the few rows of a key are sorted.
    sums = monthly.groupBy(*keys, F.col(tso).alias("_tso")).agg(
        F.max("eeg_on").alias("_on"), F.min("date").alias("_first"), F.max("strike_cod_fixed").alias("_strike"), F.sum("revenue_eur").alias("_revenue"), F.count(F.lit(1)).alias("_months"),
    )
    one = sums.groupBy(*keys).agg(
        F.max("_tso").alias("TSO"),
        F.max("_on").cast("string").alias("EEG_ON"),
        F.min("_first").cast("string").alias("COD"),
        text(F.max("_strike"), 4).alias("EEG_strike_fixed_eur_mwh"),
        text(F.sum("_revenue"), 2).alias("Total_revenue_eur"),
        text(F.sum("_revenue") / (F.sum("_months") / 12.0), 2).alias("Average_annual_revenue_eur"),
    )
    metrics = [c for c in one.columns if c not in keys]
    return one.unpivot(list(keys), metrics, "metric", "value")
