"""Scalar column functions: dates, safe division, checksums, number parsing.

Spark 4 runs in ANSI mode, so everything that may fail uses a try_ form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def clean(c: Column) -> Column:
    """NaN as null, once, where a table enters."""
    return F.when(~F.isnan(c), c)


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Fractional units between two timestamps."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / (1e6 * UNIT_SECONDS[unit])


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def row_checksum(*cols: Column) -> Column:
    """MD5 of the values as text; fields are told apart by a unit separator and nulls are empty."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def parse_yyyymmdd(c: Column) -> Column:
    """Date of an integer YYYYMMDD; any other number is null."""
    return F.when(c.between(10000101, 99991231), F.try_to_date(c.cast("string"), "yyyyMMdd"))


def parse_date(c: Column) -> Column:
    """Lenient date parse, null where it fails."""
    return F.try_to_timestamp(c).cast("date")


#: fixed values: what a letter after a number and a word behind it multiply by
SUFFIXES = {"k": 1_000.0, "m": 1_000_000.0, "b": 1_000_000_000.0}
WORDS = {"thousand": 1_000.0, "million": 1_000_000.0, "billion": 1_000_000_000.0}


def parse_number(c: Column, hint: str | None = None) -> tuple[Column, Column, Column]:
    """(value, unit, status) of a reported number, the first one in the text; thousands separators are dropped.

    A percent sign or word makes it a rate (12% is 0.12), a number in parentheses is negative, k, m, b or thousand,
    million, billion multiply, and a currency sign or code names the unit. A hint (rate, ratio, fraction, percent,
    percentage) makes a plain number a rate, and of the last two one above 1 in size is divided by 100; any other hint
    is the unit of what names none itself, which is "number" without a hint.
    """
    t = F.regexp_replace(F.lower(F.trim(c)), ",", "")
    digits = F.regexp_extract(t, r"[-+]?[0-9]+(\.[0-9]+)?", 0)
    rest = F.regexp_extract(t, r"[-+]?[0-9]+(\.[0-9]+)?(.*)", 2)
    number = digits.try_cast("double")
    value = F.when(t.rlike(r"^\(.*\)$"), -F.abs(number)).otherwise(number)
    scale = F.lit(1.0)
    for word, by in reversed(WORDS.items()):
        scale = F.when(rest.rlike(rf"\b{word}\b"), by).otherwise(scale)
    for suffix, by in SUFFIXES.items():
        scale = F.when(F.substring(rest, 1, 1) == suffix, by).otherwise(scale)
    value = value * scale
    percent = t.rlike("%| percent| percentage point")
    currency = t.rlike(r"[$£€]|\b(usd|eur|gbp)\b")
    kind = (hint or "").lower()
    rate = kind in ("rate", "ratio", "fraction", "percent", "percentage")
    hinted = F.when(F.abs(value) > 1, value / 100).otherwise(value) if kind in ("percent", "percentage") else value
    unit = F.when(percent, "rate").otherwise(F.lit("rate") if rate else F.when(currency, "currency").otherwise(hint or "number"))
    value = F.when(percent, value / 100).otherwise(hinted)
    return value, F.when(value.isNotNull(), unit), F.when(value.isNotNull(), "parsed").otherwise("unparsed")


def within(observed: Column, expected: Column, absolute: float | None = None, relative: float | None = None) -> Column:
    """|observed - expected| <= max(absolute, relative x |expected|); 1e-12 when neither is given."""
    bounds = [F.lit(absolute)] if absolute is not None else []
    bounds += [relative * F.abs(expected)] if relative is not None else []
    most = F.greatest(*bounds) if len(bounds) > 1 else bounds[0] if bounds else F.lit(1e-12)
    return F.abs(observed - expected) <= most
