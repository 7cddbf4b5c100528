"""Telemetry files of any site to one standard table of hours."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.parse import any_time, number
from ..functions.wind import specific_power
from ..operators.aggregate import telemetry_hourly
from ..operators.checks import assert_none, cadence
from ..session import settle
from ..sources.headed import read_headed
from ..sources.market import numbered_turbines
from .energy import availability, within_bounds

FILE = ["site_id", "source_file"]
CONSTANTS = ["lat", "lon", "hub_height_m", "rated_power_kw", "rotor_diameter_m", "specific_power_wpm2", "turbine_type"]
HOURS = ["ts", "turbine_id", "site_id", "energy_kwh", "wind_speed_ms", *CONSTANTS]


@dataclass
class Labels:
    """Column labels of one site's files. Without ``turbine``, files are numbered; with ``quality``, only rows flagged 1 count."""

    time: str
    target: str
    wind: str
    turbine: str | None = None
    quality: str | None = None
    sep: str = ","


def read_site(spark: SparkSession, paths: str | Sequence[str], site_id: str, labels: Labels) -> DataFrame:
    """(site_id, source_file, ts, target, wind_speed_ms, turbine, quality) of files with a plain header; rows without a time are dropped.

    Every label is required: a file that lacks one raises.
    """
    wanted = {labels.time: "time", labels.target: "target", labels.wind: "wind"}
    wanted |= {labels.turbine: "turbine"} if labels.turbine else {}
    wanted |= {labels.quality: "quality"} if labels.quality else {}
    raw = read_headed(spark, paths, wanted, labels.sep, "first", list(wanted))
    absent = F.lit(None).cast("string")
    return raw.select(
        F.lit(site_id).alias("site_id"), "source_file", any_time("time").alias("ts"), number("target").alias("target"), number("wind").alias("wind_speed_ms"),
        (F.trim("turbine") if labels.turbine else absent).alias("turbine"), (number("quality") if labels.quality else absent.cast("double")).alias("quality"),
    ).where("ts IS NOT NULL")


def classified_files(rows: DataFrame) -> DataFrame:
    """(site_id, source_file, median_minutes, cadence, turbine_id) per file; a cadence that is neither ten minutes nor an hour raises.

    A file's turbine is the one of its first row in time, or else ``<site>_T<ii>`` by the place of the file among the site's.
    """
    first = rows.groupBy(*FILE).agg(F.min_by("turbine", F.struct("ts", "turbine")).alias("turbine"))
    named = numbered_turbines(first, "site_id").withColumn("turbine_id", F.coalesce("turbine", "turbine_id")).drop("turbine")
    files = settle(named.join(cadence(rows, FILE, "ts").drop("looks_hourly"), FILE, "left"), "telemetry-files")
    assert_none(files.where("cadence IS NULL OR cadence = 'unclassified'"), "cannot classify the time step of a file")
    return files


def with_constants(files: DataFrame, meta: DataFrame, catalogue: DataFrame, sites: DataFrame) -> DataFrame:
    """Turbine constants per file: metadata first, then the type's, then the site's defaults.

    ``meta``: turbine_id, turbine_type, lat, lon, hub_height_m; ``sites``: site_id, lat, lon, hub_height_m. A turbine
    without metadata, a type that the catalogue lacks and a type without cut-in speed raise.
    """
    assert_none(files.join(meta, "turbine_id", "left_anti").select("turbine_id"), "no metadata for turbine")
    used = files.join(meta, "turbine_id")
    assert_none(used.join(catalogue, "turbine_type", "left_anti").select("turbine_id", "turbine_type"), "turbine type not in catalogue")
    spec = used.select(*files.columns, "turbine_type", *[F.col(c).alias(f"_{c}") for c in ("lat", "lon", "hub_height_m")]).join(catalogue.drop("power_curve"), "turbine_type")
    assert_none(spec.where("cut_in_ws IS NULL").select("turbine_type"), "cut-in speed missing")
    spec = spec.join(sites.select("site_id", *[F.col(c).alias(f"_site_{c}") for c in ("lat", "lon", "hub_height_m")]), "site_id", "left")
    return spec.select(
        *files.columns, "cut_in_ws", F.coalesce("_lat", "_site_lat").alias("lat"), F.coalesce("_lon", "_site_lon").alias("lon"),
        F.coalesce("_hub_height_m", "default_hub_height_m", "_site_hub_height_m").alias("hub_height_m"), "rated_power_kw", "rotor_diameter_m",
        specific_power("rated_power_kw", "rotor_diameter_m").alias("specific_power_wpm2"), "turbine_type",
    )


def standard_hours(
    rows: DataFrame, meta: DataFrame, catalogue: DataFrame, sites: DataFrame, quality: bool = False, min_power: float = 0.0, max_power: float | None = None,
) -> DataFrame:
    """Rows of :func:`read_site`, of any number of sites, to the standard table (``HOURS``).

    Files of ten-minute power become hours by the 2/3 rule: availability comes from power, wind and the type's cut-in speed, or is given where
    ``quality`` rows alone are kept; an hour with an unknown constant or wind speed is dropped. Hourly files hold energy and pass through. Unknown values and those outside the bounds are left out.
    A file is one unit: hours of two files of one turbine are not merged.
    """
    rows = settle(rows, "telemetry-rows")  # typed once; the text is not read again
    files = settle(with_constants(classified_files(rows), meta, catalogue, sites), "telemetry-turbines")
    kept = rows.where(F.coalesce(F.col("quality") == 1, F.lit(False))) if quality else rows
    kept = kept.join(files, FILE)
    hourly = within_bounds(kept.where("cadence = 'hourly'"), "target", 0.0, max_power).withColumn("energy_kwh", F.col("target"))
    fine = kept.where("cadence = '10min'").withColumn("power_kw", F.col("target"))
    fine = fine.withColumn("is_available", F.lit(True) if quality else availability("power_kw", "wind_speed_ms", "cut_in_ws"))
    rolled = telemetry_hourly(within_bounds(fine, "power_kw", min_power, max_power), [*FILE, "turbine_id"], CONSTANTS)
    return rolled.select(*HOURS).unionByName(hourly.select(*HOURS))
