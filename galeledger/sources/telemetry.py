"""Turbine telemetry and status logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.parse import any_time, number
from .headed import read_headed, readable
from .lines import header_of_files, numbered_lines, pick_columns

# Column labels of the ten-minute export and of the status log.
TELEMETRY_COLUMNS = {"Date and time": "timestamp", "Power (kW)": "power_kw", "Wind speed (m/s)": "wind_speed_ms"}
STATUS_COLUMNS = {"Timestamp start": "start_ts", "Timestamp end": "end_ts", "IEC category": "iec_category"}
FULL_PERFORMANCE = "Full Performance"


def turbine_of_file(prefix: str) -> Column:
    """``Turbine_Data_<id>_<first day>_...csv`` / ``Status_<id>_...csv`` -> id.

    The id ends at the first day of the file's span; without one, at the last underscore.
    """
    return F.regexp_extract("source_file", rf"{prefix}_([^/]+?)_(?:\d{{4}}-\d{{2}}-\d{{2}}[^/]*|[^_/]*)\.csv", 1)


def read_telemetry(
    spark: SparkSession, paths: str | Sequence[str], columns: dict[str, str] = TELEMETRY_COLUMNS, since: str | None = None, until: str | None = None,
) -> DataFrame:
    """(turbine_id, ts, power_kw, wind_speed_ms) of exports with a commented header.

    The header is the first ``#`` line that contains a comma; only the mapped columns
    are parsed. Rows whose time does not parse are dropped, and those before day ``since`` or after day ``until``.
    """
    if readable([paths] if isinstance(paths, str) else paths):
        rows = read_headed(spark, paths, columns, ",", "comment", list(columns), "timestamp", since, until)
    else:
        lines = numbered_lines(spark, paths)
        headers = header_of_files(
            lines, F.startswith(F.col("line"), F.lit("#")) & F.contains(F.col("line"), F.lit(",")),
            lambda x: F.trim(F.regexp_replace(x, r"^[# ]+", "")),
        )
        rows = pick_columns(lines.where(~F.startswith(F.col("line"), F.lit("#"))), headers, columns, ",", list(columns))
    typed = rows.select(
        turbine_of_file("Turbine_Data").alias("turbine_id"), any_time("timestamp").alias("ts"),
        *[number(c).alias(c) for c in columns.values() if c != "timestamp"],
    ).where("ts IS NOT NULL")
    typed = typed.where(F.to_date("ts") >= F.lit(since).cast("date")) if since else typed
    return typed.where(F.to_date("ts") <= F.lit(until).cast("date")) if until else typed


def read_status(spark: SparkSession, paths: str | Sequence[str], columns: dict[str, str] = STATUS_COLUMNS) -> DataFrame:
    """(turbine_id, start_ts, end_ts, iec_category); unparseable times are NULL.

    The header is the first line that is neither blank nor a comment and has two commas; what
    stands before it in its file is preamble, what stands after it is data, however few its cells.
    Where only Spark can open the files, lines of fewer than two commas are taken for preamble.
    """
    required = ["Timestamp start", "Timestamp end"]
    if readable([paths] if isinstance(paths, str) else paths):
        rows = read_headed(spark, paths, columns, ",", "commas", required)
    else:
        lines = numbered_lines(spark, paths).where(~F.startswith(F.trim("line"), F.lit("#")) & (F.length(F.trim("line")) > 0))
        commas = F.length("line") - F.length(F.replace(F.col("line"), F.lit(","), F.lit("")))
        lines = lines.where(commas >= 2)
        rows = pick_columns(lines, header_of_files(lines, F.lit(True)), columns, ",", required)
    return rows.select(
        turbine_of_file("Status").alias("turbine_id"), any_time("start_ts").alias("start_ts"), any_time("end_ts").alias("end_ts"),
        F.nullif(F.trim("iec_category"), F.lit("")).alias("iec_category"),
    )
