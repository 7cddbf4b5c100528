"""Deterministic random draws.

A draw is a hash of its own coordinates (seed, series, simulation, step), so it
is the same under any partitioning, on any retry, and in any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .expr import as_col


def hash32(*parts) -> Column:
    """First 32 bits of the md5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Draw in the open interval (0, 1)."""
    return (hash32(*parts) + 0.5) / 4294967296.0


def standard_normal(*parts) -> Column:
    """Box-Muller from two independent hashes."""
    radius = F.sqrt(-2.0 * F.log(uniform(*parts, "r")))
    return radius * F.cos(2.0 * math.pi * uniform(*parts, "a"))


def pick(n, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(hash32(*parts), as_col(n).cast("bigint"))
