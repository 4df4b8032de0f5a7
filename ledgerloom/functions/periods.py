"""Period strings: instants (YYYY-MM-DD) and durations (start/end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNUAL_DAYS = 300


def iso_date(c: Column) -> Column:
    """The date of a well-formed YYYY-MM-DD, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def period_end(period: Column) -> Column:
    """What stands after the last slash."""
    return F.element_at(F.split(period, "/"), -1)


def end_year(period: Column) -> Column:
    return F.year(iso_date(period_end(period)))


def is_annual(period: Column) -> Column:
    """Whether a duration spans at least 300 days; instants and malformed periods do not."""
    parts = F.split(period, "/", 2)
    days = F.datediff(iso_date(F.get(parts, F.lit(1))), iso_date(F.get(parts, F.lit(0))))
    return F.coalesce(days >= ANNUAL_DAYS, F.lit(False))


def year_named(text: Column) -> Column:
    """The first year from 1900 to 2099 that a question names, with or without FY or fiscal."""
    return F.nullif(F.regexp_extract(F.lower(text), r"(?:^|[^a-z0-9_])(?:fy\s?|fiscal\s+)?((?:19|20)[0-9]{2})(?:[^a-z0-9_]|$)", 1), F.lit("")).cast("int")


def period_named(text: Column) -> Column:
    """The first marker of the first kind present: quarter with year, fiscal year, year or quarter ended on a date."""
    kinds = (r"(?i)\bQ[1-4]\s*FY\s*\d{2,4}\b", r"(?i)\bFY\s*\d{2,4}\b", r"(?i)\b(?:quarter|year)\s+ended\s+[A-Za-z]+\s+\d{1,2},?\s*\d{4}\b")
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, k, 0), F.lit("")) for k in kinds])
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def fiscal_label(period: Column) -> Column:
    """FY and the year of the end, or the period as it stands."""
    return F.coalesce(F.concat(F.lit("FY"), end_year(period).cast("string")), period)


def shown_value(value: Column, unit: Column) -> Column:
    """Thousands marks, two places only for fractions, a dollar sign for USD, other units after."""
    number = F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.when(unit == "USD", F.concat(F.lit("$"), number)).otherwise(F.concat_ws(" ", number, unit))
