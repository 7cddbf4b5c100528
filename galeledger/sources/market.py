"""Market-data files: delimited exports, quarterly tables, transposed yearly reports.

Everything is read as text with an explicit schema and typed afterwards, so one bad
cell becomes NULL instead of failing the job, and no pass is spent on inference.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.calendar import month_start
from ..functions.parse import (
    EXPORT_HOUR_FORMAT, cents_per_kwh, export_time, german_month, number, sniffed_number, thousands_comma_number,
)
from ..operators.checks import require_columns
from ..operators.ordered import keep_last
from .headed import read_headed, readable
from .lines import ROW_ORDER, header_of_files, numbered_lines, pick_columns

START = "Start date"
# Labels and the switch date of the hourly price export.
PRICE_OLD = "DE/AT/LU [€/MWh] Calculated resolutions"
PRICE_NEW = "Germany/Luxembourg [€/MWh] Calculated resolutions"
PRICE_SWITCH = "2018-10-01"
WIND_VALUE = "Wind onshore [MWh] Calculated resolutions"
LOAD_VALUE = "grid load [MWh] Calculated resolutions"
REPORT_ROW = r"(?i)^MW\s+Wind\s+(Onshore|an\s+Land)$"
# Grid operators and the file-name part that identifies each.
TSO_IN_NAME = {"tennet": "TenneT", "amprion": "Amprion", "50hertz": "50Hertz", "transnet": "TransnetBW"}


def read_export(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], required: Sequence[str] = (START,), sep: str = ";") -> DataFrame:
    """The named text columns of all files of a glob, plus file and row order.

    A file that lacks a non-required column has NULL there (labels change over the years).
    """
    if readable([paths] if isinstance(paths, str) else paths):
        return read_headed(spark, paths, {c: c for c in columns}, sep, "first", required)
    lines = numbered_lines(spark, paths).where(F.length(F.trim("line")) > 0)
    headers = header_of_files(lines, F.col("source_block") == 0)
    return pick_columns(lines, headers, {c: c for c in columns}, sep, required)


def file_name(path: str = "source_file") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def tso_of_file(name) -> Column:
    """Grid operator named in a file name (any case), NULL when none is."""
    low = F.lower(name if isinstance(name, Column) else F.col(name))
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in TSO_IN_NAME.items()])


def numbered_turbines(df: DataFrame, site: str, file: str = "source_file") -> DataFrame:
    """Synthetic ``<site>_T<ii>`` from the file's position among the site's sorted files."""
    files = df.select(site, file).distinct()
    rank = F.row_number().over(Window.partitionBy(site).orderBy(file))
    named = files.select(site, file, F.format_string("%s_T%02d", F.col(site), rank).alias("turbine_id"))
    return df.join(named, [site, file])


def price_by_regime(ts, old, new, switch: str = PRICE_SWITCH) -> Column:
    """The zone's price column was renamed at the switch date."""
    return F.when(F.col(ts) < F.lit(switch).cast("timestamp_ntz"), old).otherwise(new)


def _keep_last_row(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Greatest file and row wins where an hour occurs twice (file overlap, clock change)."""
    return keep_last(rows.na.drop(subset=[*keys, value]), keys, ROW_ORDER).select(*keys, value)


def hourly_prices(raw: DataFrame) -> DataFrame:
    """(ts, price_eur_mwh) from price exports that carry the old and/or the new column."""
    typed = raw.select(export_time(F.col(f"`{START}`")).alias("ts"), F.col(f"`{PRICE_OLD}`").alias("_old"), F.col(f"`{PRICE_NEW}`").alias("_new"), *ROW_ORDER)
    price = price_by_regime("ts", sniffed_number("_old"), sniffed_number("_new"))
    return _keep_last_row(typed.select("ts", price.alias("price_eur_mwh"), *ROW_ORDER), ["ts"], "price_eur_mwh")


def export_series(
    raw: DataFrame, value: str, name: str, parse: Callable[[Column], Column] = sniffed_number, fmt: str = EXPORT_HOUR_FORMAT, keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, ts, <name>) of one value column, parsed, deduplicated keep-last."""
    require_columns(raw, [START, value])
    rows = raw.select(*keys, export_time(F.col(f"`{START}`"), fmt).alias("ts"), parse(F.col(f"`{value}`")).alias(name), *ROW_ORDER)
    return _keep_last_row(rows, [*keys, "ts"], name)


def monthly_grid_load(raw: DataFrame) -> DataFrame:
    """(tso, month, load_mwh) from monthly exports whose file name carries the operator."""
    operator = F.coalesce(tso_of_file(file_name()), F.raise_error(F.concat(F.lit("no grid operator in the name of "), F.col("source_file"))).cast("string"))
    rows = raw.select(
        operator.alias("tso"), month_start(export_time(F.col(f"`{START}`"), "MMM d, yyyy")).alias("month"),
        thousands_comma_number(F.col(f"`{LOAD_VALUE}`")).alias("load_mwh"),
    )
    return rows.groupBy("tso", "month").agg(F.coalesce(F.sum("load_mwh"), F.lit(0.0)).alias("load_mwh"))


def read_transposed_report(spark: SparkSession, paths, row_pattern: str = REPORT_ROW) -> DataFrame:
    """(source_file, month, value) of yearly reports whose header runs across months.

    A report is a page of text, so a file is one row: header and the first line
    whose label matches are split and zipped in place.
    """
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_name").alias("source_file"))
    return transposed_report_rows(files, row_pattern)


def transposed_report_rows(files: DataFrame, row_pattern: str = REPORT_ROW) -> DataFrame:
    body = F.regexp_replace("value", "\r|\ufeff", "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(F.translate(x, ";", ""))) > 0)
    cells = lambda line: F.transform(F.slice(F.split(line, ";"), 2, 12), lambda x: F.trim(x))
    wanted = F.filter("_lines", lambda x: F.rlike(F.trim(F.element_at(F.split(x, ";"), 1)), F.lit(row_pattern)))
    pages = files.withColumn("_lines", lines).select("source_file", cells(F.get("_lines", F.lit(0))).alias("_m"), cells(F.get(wanted, F.lit(0))).alias("_v"))
    missing = F.raise_error(F.concat(F.lit("the wanted row is missing in "), F.col("source_file"))).cast("array<string>")
    rows = pages.withColumn("_v", F.coalesce("_v", missing)).select("source_file", F.explode(F.arrays_zip("_m", "_v")).alias("_c")).where("_c._m != ''")
    unread = F.raise_error(F.concat(F.lit("cannot read month "), F.col("_c._m"), F.lit(" in "), F.col("source_file"))).cast("date")
    return rows.select("source_file", F.coalesce(german_month("_c._m").cast("date"), unread).alias("month"), cents_per_kwh("_c._v").alias("value"))


def read_quarterly_wide(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Comma CSV with quoted decimal-comma fields, as text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(header=True, quote='"').csv(path)


def read_series(spark: SparkSession, path: str, columns: Sequence[str], date: str, value: str, name: str, fmt: str | None = None) -> DataFrame:
    """(month, <name>): parse date, floor to month, coerce number, drop unknowns."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).options(header=True).csv(path)
    when = F.try_to_timestamp(F.col(f"`{date}`"), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(f"`{date}`"))
    return raw.select(month_start(when).alias("month"), number(F.col(f"`{value}`")).alias(name)).na.drop()
