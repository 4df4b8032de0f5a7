"""Readers for objects, notifications, bundles, HTML, XML facts and golden sets."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTIFICATION = (
    "struct<Records: array<struct<eventName: string, s3: struct<bucket: struct<name: string>, object: struct<key: string, size: bigint, contentType: string, eTag: string>>>>>"
)
MEDIA_TYPES = {"pdf": "application/pdf", "htm": "text/html", "html": "text/html", "xml": "application/xml", "xsd": "application/xml", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff"}


def objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def media_type(path: Column) -> Column:
    """Media type by extension."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(known[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit("application/octet-stream"))


def notifications(messages: DataFrame, value: str = "value") -> DataFrame:
    """One row per record of bucket notifications, with decoded keys.

    A message without Records gives no row; one that is not JSON, or lacks a key or bucket, gives a
    row with error set instead of failing the whole job.
    """
    body = F.from_json(F.col(value).cast("string"), NOTIFICATION)
    rows = messages.withColumn("_m", body)
    bad = rows.where(F.get_json_object(F.col(value).cast("string"), "$").isNull()).select(*_blank(), F.lit("not a notification").alias("error"))
    each = rows.select(F.explode("_m.Records").alias("r"))
    key = F.try_url_decode("r.s3.object.key")
    good = each.select(
        F.col("r.eventName").alias("event_name"), F.col("r.s3.bucket.name").alias("bucket"), key.alias("key"), F.col("r.s3.object.size").alias("size"), F.col("r.s3.object.contentType").alias("content_type"), F.col("r.s3.object.eTag").alias("etag"),
        F.when(key.isNull() | F.col("r.s3.bucket.name").isNull() | F.col("r.eventName").isNull(), F.lit("incomplete record")).alias("error"),
    )
    return good.unionByName(bad)


def _blank() -> list[Column]:
    kinds = {"event_name": "string", "bucket": "string", "key": "string", "size": "bigint", "content_type": "string", "etag": "string"}
    return [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]


def bundles(keys: DataFrame, key: str = "key") -> DataFrame:
    """(folder, stem, instance, schema, complete): XBRL bundles; the instance is preferred as .htm, then .html, then .xml."""
    name = F.regexp_extract(key, r"([^/]*)$", 1)
    rows = keys.select(F.col(key).alias("key"), F.regexp_replace(F.col(key), r"[^/]*$", "").alias("folder"), F.regexp_replace(name, r"(?i)(?:_(?:cal|def|lab|pre))?\.[a-z]+$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[A-Za-z]+)$", 1)).alias("ext"), name.rlike(r"(?i)_(?:cal|def|lab|pre)\.xml$").alias("linkbase"))
    rank = F.when(~F.col("linkbase"), F.when(F.col("ext") == ".htm", 0).when(F.col("ext") == ".html", 1).when(F.col("ext") == ".xml", 2))
    out = rows.groupBy("folder", "stem").agg(F.min_by("key", rank).alias("instance"), F.min(F.when(F.col("ext") == ".xsd", F.col("key"))).alias("schema"))
    return out.withColumn("complete", F.col("instance").isNotNull() & F.col("schema").isNotNull())


def plain_text(data: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not valid UTF-8."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of cases."""
    return spark.read.option("multiLine", "true").json(path)


def _attribute(element: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(element, rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def _elements(x: Column, name: str) -> Column:
    """All elements of a name, whatever their prefix."""
    return F.regexp_extract_all(x, F.lit(rf"(?s)(<(?:[\w.-]+:)?{name}\b[^>]*>.*?</(?:[\w.-]+:)?{name}>)"), 1)


def xbrl_contexts(files: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, context, period, dimension): an instant or start/end, and the explicit and typed members as axis=member sorted by axis, null without any.

    Dates are as filed, so nothing is taken off the end.
    """
    rows = files.select(key, F.explode(_elements(F.col(xml), "context")).alias("e"))
    day = lambda name: F.nullif(F.regexp_extract("e", rf"<(?:[\w.-]+:)?{name}>\s*([^<\s]+)\s*<", 1), F.lit(""))
    member = lambda m: F.concat(F.regexp_extract(m, r"dimension\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("="), F.trim(F.regexp_replace(m, r"(?s)<[^>]*>", "")))
    members = F.concat(_elements(F.col("e"), "explicitMember"), _elements(F.col("e"), "typedMember"))
    dimension = F.nullif(F.array_join(F.array_sort(F.transform(members, member)), ";"), F.lit(""))
    period = F.coalesce(day("instant"), F.concat(day("startDate"), F.lit("/"), day("endDate")))
    return rows.select(key, _attribute(F.col("e"), "id").alias("context"), period.alias("period"), dimension.alias("dimension")).dropDuplicates([key, "context"])


def xbrl_units(files: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, unit_id, unit): local names of the measures, joined by stars, with those below after a slash."""
    rows = files.select(key, F.explode(_elements(F.col(xml), "unit")).alias("e"))
    names = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"measure[^>]*>\s*(?:[\w.-]+:)?([^<\s]+)\s*<"), 1), "*")
    below = F.regexp_extract("e", r"(?s)<(?:[\w.-]+:)?unitDenominator\b.*", 0)
    unit = F.concat_ws("/", names(F.regexp_replace("e", r"(?s)<(?:[\w.-]+:)?unitDenominator\b.*", "")), F.nullif(names(below), F.lit("")))
    return rows.select(key, _attribute(F.col("e"), "id").alias("unit_id"), unit.alias("unit")).dropDuplicates([key, "unit_id"])


def xbrl_elements(files: DataFrame, key: str, xml: str, known: bool = True) -> DataFrame:
    """(key, pos, concept, context, unit_id, text, nil, period, dimension): the facts of plain instances in order.

    A fact of an unknown context goes or, if not known, stays without period and dimension.
    """
    each = files.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(<[\w.-]+:[\w.-]+\b[^<>]*\bcontextRef[^<>]*(?:/>|>[^<]*</))"), 1)).alias("pos", "e"))
    text = F.trim(F.regexp_extract("e", r">([^<]*)</$", 1))
    rows = each.select(key, "pos", F.regexp_extract("e", r"^<([\w.:-]+)", 1).alias("concept"), _attribute(F.col("e"), "contextRef").alias("context"), _attribute(F.col("e"), "unitRef").alias("unit_id"), text.alias("text"), F.coalesce(_attribute(F.col("e"), "nil").isin("true", "1"), F.lit(False)).alias("nil"))
    return rows.join(xbrl_contexts(files, key, xml), [key, "context"], "inner" if known else "left")


def xbrl_values(files: DataFrame, key: str, xml: str, known: bool = True) -> DataFrame:
    """(key, concept, period, dimension, unit, value): numeric facts (of known contexts), the first of equal concept, period, dimension and unit."""
    rows = xbrl_elements(files, key, xml, known).where("not nil and unit_id is not null").withColumn("value", F.col("text").try_cast("double")).where("value is not null")
    rows = rows.join(xbrl_units(files, key, xml), [key, "unit_id"], "left").withColumn("unit", F.coalesce("unit", F.lit("")))
    return rows.groupBy(key, "concept", "period", "dimension", "unit").agg(F.min_by("value", "pos").alias("value"))


def dei_values(files: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, name, value): facts of the entity itself (prefix dei, no dimension, not blank), the first of each name."""
    rows = xbrl_elements(files, key, xml).where("dimension is null and concept like 'dei:%' and text != ''")
    return rows.groupBy(key, F.regexp_extract("concept", ":(.*)$", 1).alias("name")).agg(F.min_by("text", "pos").alias("value"))


def dei_rows(dei: DataFrame, key: str) -> DataFrame:
    """(key, collection_id, company, ticker, cik, filing_type, fiscal_year, fiscal_period) from (key, name, value).

    Companies go by their CIK; a filing without one stands for itself.
    """
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    rows = dei.groupBy(key).agg(of("EntityCentralIndexKey").alias("cik"), of("EntityRegistrantName").alias("company"), of("TradingSymbol").alias("ticker"), of("DocumentType").alias("filing_type"), of("DocumentFiscalYearFocus").try_cast("int").alias("fiscal_year"), of("DocumentFiscalPeriodFocus").alias("fiscal_period"))
    collection = F.coalesce(F.concat(F.lit("us-cik-"), "cik"), F.concat(F.lit("us-"), F.col(key)))
    return rows.select(key, collection.alias("collection_id"), "company", "ticker", "cik", "filing_type", "fiscal_year", "fiscal_period")


def xbrl_facts(spark: SparkSession, path: str) -> DataFrame:
    """The numeric facts of the plain XBRL instances below a folder, by path; those of unknown contexts have no period."""
    files = objects(spark, path, "*.xml").select("path", F.decode("content", "UTF-8").alias("x"))
    return xbrl_values(files, "path", "x", known=False)


class _Blocks(HTMLParser):
    """Collects (kind, level, text) from headings, paragraphs and table rows."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, int, str]] = []
        self.text: list[str] = []
        self.rows: list[list[str]] = []
        self.depth = self.skip = 0

    def flush(self, kind: str = "text", level: int = 0) -> None:
        t = " ".join("".join(self.text).split())
        if t:
            self.out.append((kind, level, t))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            if not self.depth:
                self.flush()
                self.rows = []
            self.depth += 1
        elif tag == "tr" and self.depth == 1:
            self.rows.append([])
        elif tag in ("td", "th") and self.depth == 1:
            self.text = []
        elif not self.depth and tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.depth == 1 and self.rows:
            self.rows[-1].append(" ".join("".join(self.text).split()))
            self.text = []
        elif tag == "table" and self.depth:
            self.depth -= 1
            rows = [r for r in self.rows if r]
            if not self.depth and rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                lines.insert(1, "|" + " --- |" * len(rows[0]))
                self.out.append(("table", 0, "\n".join(lines)))
                self.text = []
        elif not self.depth and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.flush("title" if tag[1] == "1" else "subtitle", int(tag[1]))
        elif not self.depth and tag in ("p", "div", "li"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_items(files: DataFrame, key: str, html: str) -> DataFrame:
    """(key, seq, role, level, text): headings, paragraphs and tables (as Markdown) of HTML texts in order."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h in zip(pdf["key"], pdf["html"]):
                p = _Blocks()
                p.feed(h)
                p.close()
                p.flush()
                rows += [(k, n, *b) for n, b in enumerate(p.out)]
            yield pd.DataFrame(rows, columns=["key", "seq", "role", "level", "text"])

    rows = files.select(F.col(key).alias("key"), F.col(html).alias("html")).where(F.col(html).isNotNull())
    return rows.mapInPandas(parse, f"key {files.schema[key].dataType.simpleString()}, seq int, role string, level int, text string").withColumnRenamed("key", key)
