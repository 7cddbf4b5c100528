"""Unit conversions between the sources and the engine's MWh / kWh / EUR."""

from __future__ import annotations

from pyspark.sql import Column

from .expr import as_col


def gwh_to_mwh(x) -> Column:
    return as_col(x) * 1000.0


def mw_to_kw(x) -> Column:
    return as_col(x) * 1000.0


def ten_minute_kw_to_kwh(x) -> Column:
    return as_col(x) / 6.0


def yearly_to_monthly(x) -> Column:
    return as_col(x) / 12.0


def kwh_to_mwh(x) -> Column:
    return as_col(x) / 1000.0
