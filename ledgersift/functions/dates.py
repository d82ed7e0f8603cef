"""Dates from text and periods of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats; the first that fits wins, so month comes before day where both fit.
DATE_FORMATS = [
    "yyyy-M-d", "yyyy/M/d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s'Z'", "M/d/yyyy", "M-d-yyyy", "M/d/yy", "M-d-yy",
    "d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy", "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy", "d MMM yy", "MMM d, yyyy", "MMM d yyyy",
    "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "d MMMM, yyyy",
]


def parse_date(c: Column) -> Column:
    """The date of a text in any of the accepted formats, or null. Ordinal endings are dropped; years 69 to 99 are 19xx."""
    text = F.regexp_replace(F.trim(c), r"(\d+)(?:st|nd|rd|th)\b", "$1")
    found = []
    for f in DATE_FORMATS:
        d = F.try_to_date(text, f)
        if f.endswith("yy") and not f.endswith("yyyy"):
            d = F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)
        found.append(d)
    return F.coalesce(*found)


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.date_diff(b, a))


def months_between(a: Column, b: Column) -> Column:
    """Whole calendar months, whatever the day."""
    return F.abs((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a))


def is_weekend(c: Column) -> Column:
    return F.weekday(c) >= 5


def is_business_day(c: Column) -> Column:
    """Monday to Friday."""
    return F.weekday(c) < 5


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c), F.lit("-Q"), F.quarter(c))


def period(c: Column, kind: str) -> Column:
    """daily, weekly (ISO), monthly or quarterly label."""
    if kind == "daily":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), c), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
    if kind == "monthly":
        return F.date_format(c, "yyyy-MM")
    if kind == "quarterly":
        return quarter_label(c)
    raise ValueError(f"unknown period: {kind!r}")
