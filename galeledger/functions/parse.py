"""Text to number and text to time. One parser per source: the same text can
mean different numbers in different exports, so nothing here is shared by guess."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .expr import as_col

# German month abbreviations as printed in the yearly reports
# (March appears in two spellings).
GERMAN_MONTHS = {
    "Jan": 1, "Feb": 2, "Mär": 3, "Mrz": 3, "Apr": 4, "Mai": 5, "Jun": 6,
    "Jul": 7, "Aug": 8, "Sep": 9, "Okt": 10, "Nov": 11, "Dez": 12,
}

EXPORT_HOUR_FORMAT = "MMM d, yyyy h:mm a"
EXPORT_DAY_FORMAT = "MMM d, yyyy"

# Day-first layouts accepted for telemetry timestamps, tried in this order.
TELEMETRY_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss.SSS",
    "d.M.yyyy HH:mm:ss", "d.M.yyyy HH:mm", "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm",
    "yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy",
]


def number(c) -> Column:
    """Plain numeric coercion: unparseable text and NaN become NULL."""
    v = as_col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def sniffed_number(c) -> Column:
    """Number in unknown locale: of ``,`` and ``.`` the last one is the decimal mark.

    A lone comma is a decimal comma, a lone dot a decimal point. Everything but
    digits, marks and minus is dropped, so the texts that mean "missing" (blank,
    dashes, ``nan``, ``None``) keep nothing a number could be read from.
    """
    body = F.regexp_replace(as_col(c), r"[^0-9,.\-]", "")
    # 0 when absent; otherwise the distance from the end, so the smaller one is the last.
    from_end = F.reverse(body)
    comma, dot = F.instr(from_end, ","), F.instr(from_end, ".")
    plain = (
        F.when((comma == 0), body)
        .when(dot == 0, F.translate(body, ",", "."))
        .when(comma < dot, F.translate(body, ",.", "."))
        .otherwise(F.translate(body, ",", ""))
    )
    return plain.try_cast("double")


def thousands_comma_number(c) -> Column:
    """``9,399,413.00`` -> 9399413.0; dashes and blanks are missing."""
    return number(F.trim(F.replace(as_col(c), F.lit(","), F.lit(""))))


def german_number(c) -> Column:
    """``1.234,56`` -> 1234.56."""
    return number(F.trim(F.replace(F.replace(as_col(c), F.lit("."), F.lit("")), F.lit(","), F.lit("."))))


def cents_per_kwh(c) -> Column:
    """German ct/kWh text to EUR/MWh; blank or dash is missing."""
    bare = F.replace(F.replace(F.trim(as_col(c)), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return number(bare) * 10


def export_time(c, fmt: str = EXPORT_HOUR_FORMAT) -> Column:
    """Wall-clock time of a market export, NULL when it does not parse."""
    return F.try_to_timestamp(as_col(c), F.lit(fmt)).cast("timestamp_ntz")


def any_time(c, formats=TELEMETRY_FORMATS) -> Column:
    """UTC instant in the first layout that parses."""
    c = F.trim(as_col(c))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def day_first_date(c) -> Column:
    return F.try_to_timestamp(F.trim(as_col(c)), F.lit("d.M.yyyy")).cast("date")


def german_month(c) -> Column:
    """``Mär 2017`` -> 2017-03-01."""
    c = F.trim(as_col(c))
    names = F.create_map(*[F.lit(x) for kv in GERMAN_MONTHS.items() for x in kv])
    abbr = F.regexp_extract(c, r"^([A-Za-zÄÖÜäöü]{3})\s+(\d{4})", 1)
    year = F.regexp_extract(c, r"^([A-Za-zÄÖÜäöü]{3})\s+(\d{4})", 2).try_cast("int")
    month = F.try_element_at(names, abbr)
    return F.when(year.isNotNull() & month.isNotNull(), F.make_date(year, month, F.lit(1)))


def quarter_label(c) -> Column:
    """First day of the quarter for ``Q1 2015``, ``2015Q1``, ``2015-Q1`` or ``2015 Q1``."""
    c = F.upper(F.trim(as_col(c)))
    lead, tail = r"^Q([1-4])\s+(\d{4})$", r"^(\d{4})[\s\-]*Q([1-4])$"
    year = F.coalesce(F.nullif(F.regexp_extract(c, tail, 1), F.lit("")), F.nullif(F.regexp_extract(c, lead, 2), F.lit("")))
    qn = F.coalesce(F.nullif(F.regexp_extract(c, tail, 2), F.lit("")), F.nullif(F.regexp_extract(c, lead, 1), F.lit("")))
    return F.when(qn.isNotNull(), F.make_date(year.try_cast("int"), (qn.try_cast("int") - 1) * 3 + 1, F.lit(1)))
