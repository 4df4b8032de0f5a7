"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import conversations, encoding, leakage, mojibake, pii, scans, segmentation, survivorship


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.split_oversized(table(spark, sf_dir, "parsed_items")).select("item_id").where("item_id is not null").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.split_oversized(table(spark, sf_dir, "parsed_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.found(table(spark, sf_dir, "chat_messages"), table(spark, sf_dir, "chat_sessions"))


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf_dir, "chat_messages"), table(spark, sf_dir, "chat_sessions"), keep_linked=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(table(spark, sf_dir, "parsed_items"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(table(spark, sf_dir, "parsed_items"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.sources(table(spark, sf_dir, "filings"))


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.survivors(table(spark, sf_dir, "filings"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, chunks = table(spark, sf_dir, "chat_messages"), table(spark, sf_dir, "chunks")
    every = messages.select("text").unionByName(chunks.select("text")).where("text is not null")
    return pii.redact(pii.sources(messages, chunks), ["src", "rec_id"], model=pii.learn(every))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p5_redacted(spark, sf_dir).select("src", "rec_id", F.explode("entities").alias("entity"))
    return found.where(F.col("rec_id").isNotNull()).distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", F.col("item").alias("item_id"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore_texts(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_conversations, p3_found, p3_repaired, p4_found, p4_survivors, p5_found, p5_redacted, p6_ids, p7_found, p7_leaks, p8_found, p8_restored)
}

# white space as Python strips it
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_COMPANY = "regexp_replace(regexp_replace(lower(split_part(logical_key, '|', 1)), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')"
for _ in range(2):
    _COMPANY = f"regexp_replace({_COMPANY}, '{survivorship.LEGAL_SUFFIX}', '')"
_MISSING = ", ".join(f"'{p}'" for p in survivorship.PLACEHOLDERS)
_TEXT = "CASE WHEN lower(trim(regexp_replace({0}, '[\\s\\x{{a0}}]+', ' ', 'g'))) NOT IN (" + _MISSING + ") THEN trim(regexp_replace({0}, '[\\s\\x{{a0}}]+', ' ', 'g')) END"
_FORM = "nullif(regexp_replace(trim(regexp_replace(upper(trim({0})), '\\s*/\\s*A$', '')), '[\\s_]+', '_', 'g'), '')"

SQL: dict[str, str] = {
    "p1_found": f"SELECT DISTINCT item_id FROM parsed_items WHERE item_id IS NOT NULL AND length(regexp_replace(text, '^{_WHITE}|{_WHITE}$', '', 'g')) > 2048",
    "p2_found": f"""WITH m AS (SELECT id, max(nullif(lower(trim(session_id)), '')) AS s, max(role) AS role, max(text) AS text, max(created_at) AS made FROM chat_messages WHERE id IS NOT NULL GROUP BY id),
r AS (SELECT *, CASE WHEN lower(trim(role)) IN {conversations.USER} THEN 'user' WHEN lower(trim(role)) IN {conversations.ASSISTANT} THEN 'assistant' END AS side FROM m WHERE s IS NOT NULL),
known AS (SELECT lower(trim(id)) AS s, min(id) AS own FROM chat_sessions WHERE trim(id) <> '' GROUP BY 1),
kept AS (SELECT s FROM r GROUP BY s HAVING bool_and(side IS NOT NULL AND made IS NOT NULL AND coalesce(regexp_matches(text, '[\\p{{L}}\\p{{N}}]'), false))),
o AS (SELECT r.*, lag(side) OVER w AS side_before, lag(text) OVER w AS text_before FROM r SEMI JOIN kept USING (s) WINDOW w AS (PARTITION BY s ORDER BY made, side DESC, id)),
t AS (SELECT s, id, side, row_number() OVER w AS turn, lag(side) OVER w AS before, count(*) OVER (PARTITION BY s) AS n FROM o WHERE side_before IS NULL OR side_before <> side OR text_before <> text WINDOW w AS (PARTITION BY s ORDER BY made, side DESC, id)),
good AS (SELECT s FROM t GROUP BY s HAVING bool_and(CASE WHEN turn = 1 THEN side = 'user' ELSE side <> before END) AND bool_or(turn = n AND side = 'assistant'))
SELECT own AS session_id, turn::INT AS turn, id AS message_id FROM t SEMI JOIN good USING (s) JOIN known USING (s)""",
    "p4_found": f"""WITH k AS (SELECT filing_id, {_TEXT.format("filing_type")} AS filing_type, CASE WHEN fiscal_year NOT IN {survivorship.PLACEHOLDER_YEARS} THEN fiscal_year END AS fiscal_year, {_TEXT.format("fiscal_period")} AS fiscal_period,
CASE WHEN filed_date NOT IN (DATE '1900-01-01', DATE '1970-01-01', DATE '9999-12-31') THEN filed_date END AS filed_date, {_TEXT.format("source_url")} AS source_url, version,
nullif({_COMPANY}, '') AS company, {_FORM.format("split_part(logical_key, '|', 2)")} AS form, upper(trim(coalesce(split_part(logical_key, '|', 3), ''))) AS span FROM filings WHERE filing_id IS NOT NULL),
g AS (SELECT *, coalesce(form, {_FORM.format("filing_type")}) AS family, coalesce(try_cast(nullif(regexp_extract(span, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1), '') AS INT), 2000 + try_cast(nullif(regexp_extract(span, 'FY\\s*''?([0-9]{{2}})(?:[^0-9]|$)', 1), '') AS INT), fiscal_year) AS year,
coalesce(nullif(regexp_extract(span, '(Q[1-4]|H[12])', 1), ''), CASE WHEN span LIKE '%FY%' THEN 'FY' END, upper(fiscal_period)) AS named FROM k WHERE company IS NOT NULL),
h AS (SELECT *, coalesce(named, CASE WHEN family IN ('10-K', '10-KT', '20-F', '40-F', '11-K', 'ANNUAL_REPORT') THEN 'FY' END) AS period FROM g),
x AS (SELECT *, count(DISTINCT filing_id) OVER w AS members, first_value(filing_id) OVER (w ORDER BY version DESC NULLS LAST, filed_date DESC NULLS LAST, filing_id) AS survivor_id FROM h WHERE family IS NOT NULL AND year IS NOT NULL AND period IS NOT NULL WINDOW w AS (PARTITION BY company, family, year, period)),
f AS (SELECT survivor_id, filing_id, version, filed_date, unnest([{{'f': 'filing_type', 'v': filing_type}}, {{'f': 'fiscal_year', 'v': fiscal_year::VARCHAR}}, {{'f': 'fiscal_period', 'v': fiscal_period}}, {{'f': 'filed_date', 'v': filed_date::VARCHAR}}, {{'f': 'source_url', 'v': source_url}}]) AS c FROM x WHERE members > 1)
SELECT survivor_id, c.f AS field, filing_id AS source_id FROM f WHERE c.v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY survivor_id, c.f ORDER BY version DESC NULLS LAST, filed_date DESC NULLS LAST, filing_id) = 1""",
}
