"""The fact warehouse: loads, versions, and the best fact for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods, rules


def first_write_wins(incoming: DataFrame, existing: DataFrame | None, key: str, order: list[str]) -> DataFrame:
    """Rows to append: the first per key in the given order, without keys that are already stored.

    One aggregate picks the row (combined on the map side, so a hot key is no problem), one
    anti-join drops what is there. Rows with a null key are dropped, as a primary key would.
    """
    rest = [c for c in incoming.columns if c != key and c not in order]
    row = F.struct(*order, *rest)
    fresh = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("row"))
    if existing is not None:
        fresh = fresh.join(existing.select(key), key, "left_anti")
    return fresh.select(key, "row.*").select(*incoming.columns)


def last_write_wins(stored: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The stored rows with the incoming ones over them; of several incoming the one that orders last."""
    fresh = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*incoming.columns), F.struct(*order)).alias("row")).select("row.*")
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def distinct_facts(facts: DataFrame) -> DataFrame:
    """The first fact (by fact_id, then value) per filing, concept, period, dimension and unit; a null dimension is a value."""
    group = ["filing_id", "concept", "period", "dimension", "unit"]
    return facts.groupBy(*group).agg(F.min(F.struct("fact_id", "value", "origin")).alias("f")).select(*group, "f.*")


def one_filing_each(filings: DataFrame) -> DataFrame:
    """Filings that were loaded twice once, the smallest row by version first."""
    rest = [c for c in filings.columns if c != "filing_id"]
    return filings.where(F.col("filing_id").isNotNull()).groupBy("filing_id").agg(F.min(F.struct("version", *[c for c in rest if c != "version"])).alias("f")).select("filing_id", "f.*")


def orphans(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts whose filing is unknown or null."""
    return facts.join(filings.select("filing_id").distinct(), "filing_id", "left_anti")


def with_collection(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts of known filings with their collection. The planner broadcasts the filings if they are
    small enough; else AQE splits a filing that holds a large share of the facts."""
    return facts.join(one_filing_each(filings).select("filing_id", "collection_id"), "filing_id")


def top_line(facts: DataFrame, concepts: list[str], collection: str | None = None) -> DataFrame:
    """Undimensioned facts of the concepts; no concept, no row."""
    if not concepts:
        return facts.limit(0)
    out = facts.where(F.col("concept").isin(*concepts) & F.col("dimension").isNull())
    return out.where(F.col("collection_id") == collection) if collection else out


def best_facts(facts: DataFrame, by: list[str]) -> DataFrame:
    """One fact per group: annual before other durations, latest end first, then fact_id and value.

    An aggregate over ordered structs: nothing is sorted per group.
    """
    annual = periods.is_annual(F.col("period")).cast("int")
    end = periods.period_end(F.col("period"))
    best = F.max_by(F.struct("fact_id", "value", "unit", "period"), F.struct(annual, end, F.struct(_inverted("fact_id"), -F.col("value"))))
    return facts.where(F.col("period").isNotNull()).groupBy(*by).agg(best.alias("f")).select(*by, "f.*")


def _inverted(column: str) -> Column:
    """Hexadecimal ids in reverse order, so that the smallest one is the largest."""
    return F.translate(F.lower(F.coalesce(column, F.lit("g"))), "0123456789abcdef", "fedcba9876543210")


def latest_filings(filings: DataFrame) -> DataFrame:
    """The filing of each logical key with the highest version, then the latest date (missing last), then the smallest id."""
    w = Window.partitionBy("logical_key").orderBy(F.desc_nulls_last("version"), F.desc_nulls_last("filed_date"), F.col("filing_id"))
    keyed = one_filing_each(filings).where(F.trim("logical_key") != "")
    return keyed.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def collect_garbage(facts: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and filings without what a later version of the same key supersedes; unkeyed filings stay."""
    old = one_filing_each(filings).where(F.trim("logical_key") != "").join(latest_filings(filings).select("filing_id"), "filing_id", "left_anti").select("filing_id")
    return facts.join(old, "filing_id", "left_anti"), filings.join(old, "filing_id", "left_anti")


def concept_index(facts: DataFrame, filings: DataFrame) -> DataFrame:
    return with_collection(facts, filings).select("collection_id", "concept").distinct()


# Suffixes of company names, taken off once each in this order.
SUFFIXES = ("incorporated", r"inc\.", "inc", r"co\.", "co", r"ltd\.", "ltd", "corporation", r"corp\.", "corp", "plc")


def core_word(company: Column) -> Column:
    """First word of a company's name without suffixes, null if it has two letters or fewer."""
    name = F.trim(F.replace(F.lower(company), F.lit(","), F.lit("")))
    for s in SUFFIXES:
        name = F.regexp_replace(name, rf" {s}$", "")
    word = F.get(F.split(F.trim(name), r"\s+"), F.lit(0))
    return F.when(F.char_length(word) > 2, word)


def companies_named(questions: DataFrame, collections: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, collection_id): the company a question names, by ticker before name, smallest id first.

    The words of questions are joined with tickers and names; no pair is compared otherwise.
    """
    bare = F.regexp_replace(F.lower(text), r"'s|,", " ")
    words = questions.select(key, F.explode(F.array_distinct(F.split(bare, r"\s+"))).alias("word")).where(F.col("word") != "")
    ticker = collections.select(F.lower("ticker").alias("word"), F.lit(0).alias("phase"), "collection_id")
    name = collections.select(core_word(F.col("company")).alias("word"), F.lit(1).alias("phase"), "collection_id")
    known = ticker.unionByName(name).where("word is not null and word <> ''").groupBy("word").agg(F.min(F.struct("phase", "collection_id")).alias("hit"))
    return words.join(known, "word").groupBy(key).agg(F.min("hit").alias("hit")).select(key, F.col("hit.collection_id").alias("collection_id"))


def answer_questions(questions: DataFrame, facts: DataFrame, filings: DataFrame, collections: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, metric, collection_id, year, concept, value, unit, period, answer): exact answers.

    A question needs a known metric and company; with a year only facts that end in it count. Of a
    metric's concepts the first one with a fact answers. Questions without an answer give no row.
    """
    t = F.col(text)
    asked = questions.select(key, text, rules.metric_named(t).alias("metric"), periods.year_named(t).alias("year")).where("metric is not null")
    asked = asked.join(companies_named(asked, collections, key, text), key).drop(text)
    spark = questions.sparkSession
    concepts = spark.createDataFrame([(m, c, k) for m, cs in rules.METRICS.items() for k, c in enumerate(cs)], "metric string, concept string, choice int")
    wanted = asked.join(F.broadcast(concepts), "metric")
    usable = with_collection(facts.where(F.col("dimension").isNull() & F.col("period").isNotNull()), filings)
    usable = usable.withColumns({"annual": periods.is_annual(F.col("period")).cast("int"), "ends": periods.period_end(F.col("period")), "end_year": periods.end_year(F.col("period"))})
    # one best fact per collection, concept and year first: questions then meet few rows
    order = F.struct("annual", "ends", _inverted("fact_id"), -F.col("value"))
    best = usable.groupBy("collection_id", "concept", "end_year").agg(F.max_by(F.struct("value", "unit", "period"), order).alias("f"), F.max(order).alias("order"))
    hits = wanted.join(best, ["collection_id", "concept"]).where("year is null or year = end_year")
    top = hits.groupBy(key, "metric", "collection_id", "year").agg(F.max_by(F.struct("concept", "f"), F.struct(-F.col("choice"), "order")).alias("t"))
    out = top.select(key, "metric", "collection_id", "year", "t.concept", "t.f.value", "t.f.unit", "t.f.period")
    return out.withColumn("answer", F.concat(F.col("metric"), F.lit(" for "), periods.fiscal_label(F.col("period")), F.lit(": "), periods.shown_value(F.col("value"), F.col("unit"))))
