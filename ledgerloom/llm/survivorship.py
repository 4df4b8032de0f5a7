"""One surviving record for each group of versions of one filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("filing_type", "fiscal_year", "fiscal_period", "filed_date", "source_url")

# What stands for a missing value in the filings table.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "tbd", "unknown", "undefined", "?")
PLACEHOLDER_YEARS = (0, 1900, 9999)
PLACEHOLDER_DATES = ("1900-01-01", "1970-01-01", "9999-12-31")
# Legal suffixes that do not belong to a company's name.
LEGAL_SUFFIX = "_(?:incorporated|inc|corporation|corp|company|co|limited|ltd|llc|llp|plc|ag|sa|nv|gmbh|pvt|private)$"


def text_value(c: Column) -> Column:
    """The trimmed text, null where it is a placeholder."""
    t = F.trim(F.regexp_replace(c, r"[\s ]+", " "))
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)


def year_value(c: Column) -> Column:
    return F.when(~c.isin(*PLACEHOLDER_YEARS), c)


def date_value(c: Column) -> Column:
    return F.when(~c.isin(*[F.lit(d).cast("date") for d in PLACEHOLDER_DATES]), c)


def company_name(c: Column) -> Column:
    """Lower case, words joined by one underscore, without legal suffixes."""
    slug = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_")
    slug = F.regexp_replace(slug, r"^_+|_+$", "")
    for _ in range(2):
        slug = F.regexp_replace(slug, LEGAL_SUFFIX, "")
    return F.when(slug != "", slug)


def form_family(c: Column) -> Column:
    """Upper case with underscores for blanks; an amendment (/A) is its base form."""
    form = F.regexp_replace(F.upper(F.trim(c)), r"\s*/\s*A$", "")
    form = F.regexp_replace(F.trim(form), r"[\s_]+", "_")
    return F.when(form != "", form)


def logical_group(df: DataFrame) -> DataFrame:
    """Adds company, family, year and period of each row's logical_key.

    A part that the key lacks is taken from filing_type, fiscal_year and fiscal_period; rows
    whose key is null or blank, or that stay without one of the parts, get null.
    """
    part = F.split(F.col("logical_key"), r"\|")
    key = lambda k: F.trim(F.get(part, F.lit(k)))
    span = F.upper(F.coalesce(key(2), F.lit("")))
    long_year = F.regexp_extract(span, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)
    short_year = F.regexp_extract(span, r"FY\s*'?([0-9]{2})(?![0-9])", 1)
    year = F.when(long_year != "", long_year.cast("int")).when(short_year != "", short_year.cast("int") + 2000)
    rest = F.regexp_replace(span, r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", "")
    quarter = F.regexp_extract(rest, r"(Q[1-4]|H[12])", 1)
    period = F.when(quarter != "", quarter).when(rest.contains("FY"), "FY")
    named = F.upper(text_value(F.col("fiscal_period")))
    family = F.coalesce(form_family(key(1)), form_family(text_value(F.col("filing_type"))))
    yearly = family.isin("10-K", "10-KT", "20-F", "40-F", "11-K", "ANNUAL_REPORT")
    return df.withColumns(
        {
            "company": company_name(key(0)),
            "family": family,
            "year": F.coalesce(year, year_value(F.col("fiscal_year"))),
            "period": F.coalesce(period, named, F.when(yearly, "FY")),
        }
    )


def survivors(df: DataFrame) -> DataFrame:
    """One row per group of two or more different filing_id: the group, survivor_id and, for each
    field, its best value and the filing_id it comes from (<field>_from).

    Each attribute is decided by one aggregation over composite structs in rank order: rows with a
    value first, then version, filed date and filing_id. As filing_id ranks ascending, the structs
    hold negated numbers and the smallest one wins. The aggregation combines on the map side,
    so a hot group costs one row per task; nothing is collected per group. Missing versions rank
    last, missing or placeholder dates last within a version; rows loaded twice change nothing;
    rows without filing_id or without a key join no group. Other columns are ignored.
    """
    rows = logical_group(df.select("filing_id", "version", "logical_key", *FIELDS)).where(
        F.col("filing_id").isNotNull() & F.col("company").isNotNull() & F.col("family").isNotNull() & F.col("year").isNotNull() & F.col("period").isNotNull()
    )
    value = {
        "filing_type": text_value(F.col("filing_type")),
        "fiscal_year": year_value(F.col("fiscal_year")),
        "fiscal_period": text_value(F.col("fiscal_period")),
        "filed_date": date_value(F.col("filed_date")),
        "source_url": text_value(F.col("source_url")),
    }
    filed = F.coalesce(F.unix_date(value["filed_date"]), F.lit(-(2**31)))
    rank = [(-F.coalesce(F.col("version"), F.lit(-(2**31) + 1)).cast("long")).alias("v"), (-filed.cast("long")).alias("d"), F.col("filing_id")]
    best = [F.min(F.struct(value[f].isNull().alias("missing"), *rank, value[f].alias("value"))).alias(f) for f in FIELDS]
    group = ["company", "family", "year", "period"]
    out = (
        rows.groupBy(*group)
        .agg(F.min(F.struct(*rank)).alias("first"), F.min("filing_id").alias("low"), F.max("filing_id").alias("high"), *best)
        .where(F.col("low") != F.col("high"))
    )
    return out.select(
        *group,
        F.col("first.filing_id").alias("survivor_id"),
        *[c for f in FIELDS for c in (F.col(f"{f}.value").alias(f), F.when(~F.col(f"{f}.missing"), F.col(f"{f}.filing_id")).alias(f"{f}_from"))],
    )


def sources(df: DataFrame) -> DataFrame:
    """(survivor_id, field, source_id): where each surviving value comes from; no row without a value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_from").alias("source_id")) for f in FIELDS])
    return survivors(df).select("survivor_id", F.inline(pairs)).where(F.col("source_id").isNotNull())
