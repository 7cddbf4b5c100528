"""Registered queries: every operator on the driver's tables, with its SQL twin."""

from .base import REGISTRY, SQL
from . import sources, sinks, parsing, projections, calendars, joins, aggregations, windows, models, forecasts, energy, finance, geo, stream  # noqa: F401

__all__ = ["REGISTRY", "SQL"]
