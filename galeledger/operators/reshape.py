"""Wide/long changes of shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def melt_measures(df: DataFrame, ids: Sequence[str], groups: Sequence[str], measures: dict[str, str], name: str) -> DataFrame:
    """``<group><suffix>`` columns to one row per group with a column per measure.

    ``measures`` maps output column -> column suffix.
    """
    rows = F.explode(F.array(*[
        F.struct(F.lit(g).alias(name), *[F.col(f"`{g}{suffix}`").alias(m) for m, suffix in measures.items()]) for g in groups
    ]))
    return df.select(*ids, rows.alias("_r")).select(*ids, "_r.*")


def pivot_sum(df: DataFrame, ids: Sequence[str], name: str, levels: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """One column per level; the levels are given, so no extra pass finds them."""
    wide = df.groupBy(*ids).pivot(name, list(levels)).agg(F.sum(value))
    return wide.withColumnsRenamed({lv: f"{prefix}{lv}" for lv in levels})


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """By name; a column one side lacks becomes a typed NULL."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first
