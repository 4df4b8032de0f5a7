"""Identity of filings from their keys, forms and cover texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods, rules
from ..functions import text as tx
from .chunking import sections


def market_of(path: Column) -> Column:
    """US or IN from the first part of an object key; anything else is an error value, null."""
    first = F.lower(F.get(F.split(path, "/"), F.lit(0)))
    return F.when(first == "us", "US").when(first == "india", "IN")


def required_market(path: Column) -> Column:
    """As market_of, but anything else fails the query."""
    return F.coalesce(market_of(path), F.raise_error(F.concat(F.lit("no market in the key "), F.coalesce(path, F.lit("null")))))


def cover_texts(items: DataFrame, lead: int = 300) -> DataFrame:
    """(source_doc_id, cover): of each section on the smallest page with a block its title and the start of its first block there.

    Documents without pages give their first section. Documents with headings alone give the title of the first.
    """
    rows = sections(items).withColumn("heading", F.coalesce(F.col("role").isin("title", "subtitle"), F.lit(False)))
    about = rows.groupBy("source_doc_id").agg(F.min(F.when(~F.col("heading"), F.col("page"))).alias("cover"), F.min("section").alias("first"))
    rows = rows.join(about, "source_doc_id").where(F.col("heading") | F.col("cover").isNull() | (F.col("page") == F.col("cover")))
    rows = rows.where(F.col("cover").isNotNull() | (F.col("section") == F.col("first")))
    place, bare = F.struct("seq", "item_id"), F.trim("text")
    block = F.min_by(F.when(~F.col("heading"), F.substring(bare, 1, lead)), F.when(~F.col("heading"), place)).alias("block")
    each = rows.groupBy("source_doc_id", "section", "cover").agg(F.min_by(F.when(F.col("heading"), F.col("text")), F.when(F.col("heading"), place)).alias("title"), block)
    each = each.where(F.col("block").isNotNull() | F.col("cover").isNull()).select("source_doc_id", F.struct("section", F.concat_ws(" \n ", "title", "block").alias("t")).alias("s"))
    return each.groupBy("source_doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), " \n ").alias("cover"))


def upload_parts(path: Column) -> Column:
    """The first two parts of a key with three or more, else null."""
    parts = F.split(path, "/", 3)
    return F.when(F.size(parts) == 3, F.struct(F.get(parts, F.lit(0)).alias("country"), F.get(parts, F.lit(1)).alias("upload_id")))


def logical_key(company: Column, family: Column, period: Column) -> Column:
    return F.concat_ws("|", company, family, F.coalesce(period, F.lit("")))


def identify_us(filings: DataFrame) -> DataFrame:
    """Exact identity from form and period; a missing form is flagged for review. The year is part of the key."""
    family = rules.form_family(F.col("filing_type"))
    period = F.concat_ws(" ", F.nullif(F.col("fiscal_period"), F.lit("")), F.concat(F.lit("FY"), F.col("fiscal_year").cast("string")))
    return filings.withColumns(
        {
            "doc_type": family,
            "numeric_authority": rules.authority(F.col("filing_type"), F.lit(None).cast("string")),
            "key": logical_key(tx.slug(F.col("company")), F.coalesce(family, F.lit("exhibit")), period),
            "confidence": F.when(family.isNotNull(), 1.0).otherwise(0.3),
            "needs_review": family.isNull(),
        }
    )


def identify_by_cover(documents: DataFrame, company: str, cover: str) -> DataFrame:
    """Kind and period from the cover text by rules (confidence 0.9), else unknown with a low one and a flag."""
    kind, period = rules.kind_from_title(F.col(cover)), periods.period_named(F.col(cover))
    return documents.withColumns(
        {
            "doc_type": F.coalesce(kind, F.lit("unknown")),
            "period": period,
            "numeric_authority": rules.authority(F.lit(None).cast("string"), kind),
            "key": logical_key(tx.slug(F.col(company)), F.coalesce(kind, F.lit("unknown")), period),
            "confidence": F.when(kind.isNotNull(), 0.9).otherwise(0.3),
            "needs_review": kind.isNull(),
        }
    )


def arms(files: DataFrame, data: str) -> DataFrame:
    """Adds format and arm: facts for XBRL instances, bundle for schemas and other XML, quarantine for unknown, else pages."""
    fmt, role = rules.sniffed(F.col(data)), rules.xbrl_role(F.col(data))
    arm = F.when(fmt == "unknown", "quarantine").when(role.isin("inline", "instance"), "facts").when((fmt == "xml") | (role == "schema"), "bundle").otherwise("pages")
    return files.withColumns({"format": fmt, "arm": arm})
