"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, periods, rules
from ..functions import text as tx
from ..functions.vectors import cosine
from ..operators import answering, chat, chunking, evaluation, facts, gate, identity, monitor, redaction, retrieval, sqlguard
from ..session import cut_lineage, table, written
from ..sources import readers
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Read = Callable[[str], DataFrame]

# ---- SQL parts that several queries share

ISO = "CASE WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast({0} AS DATE) END"
ENDS = "list_extract(string_split(period, '/'), -1)"
ANNUAL = f"(len(string_split(period, '/')) = 2 AND coalesce({ISO.format('split_part(period, $$/$$, 2)')} - {ISO.format('split_part(period, $$/$$, 1)')} >= 300, false))"
FILINGS = "one_filing AS (SELECT * FROM filings WHERE filing_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY version) = 1)"
MESSAGES = "one_message AS (SELECT * FROM chat_messages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST) = 1)"
WORDS = "coalesce(regexp_extract_all(lower(text), '[a-z0-9]+'), [])"
SPACE = r"[\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SPACED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def query(sql: str | None = None):
    """Registers a function of a table reader under its own name, with the SQL that must agree."""

    def add(f: Callable[[Read], DataFrame]) -> Callable[[Read], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the fact warehouse


@query(f"""WITH {FILINGS}, f AS (SELECT g.collection_id, x.* FROM financial_facts x JOIN one_filing g USING (filing_id) WHERE x.dimension IS NULL AND x.period IS NOT NULL)
SELECT collection_id, concept, fact_id, value, unit, period FROM f
QUALIFY row_number() OVER (PARTITION BY collection_id, concept ORDER BY {ANNUAL} DESC, {ENDS} DESC, fact_id, value) = 1""")
def fact_best_per_company(t: Read) -> DataFrame:
    """The best top-line fact of each company and concept."""
    rows = facts.with_collection(t("financial_facts").where("dimension is null"), t("filings"))
    return facts.best_facts(rows, ["collection_id", "concept"])


@query(f"""WITH {FILINGS} SELECT g.collection_id, x.concept, count(*) AS n, min(x.value) AS low, max(x.value) AS high
FROM financial_facts x JOIN one_filing g USING (filing_id) WHERE x.dimension IS NULL AND x.concept IN ('us-gaap:Revenues', 'us-gaap:NetIncomeLoss', 'us-gaap:Assets') GROUP BY ALL""")
def fact_filter_top_line(t: Read) -> DataFrame:
    rows = facts.top_line(facts.with_collection(t("financial_facts"), t("filings")), ["us-gaap:Revenues", "us-gaap:NetIncomeLoss", "us-gaap:Assets"])
    return rows.groupBy("collection_id", "concept").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT * FROM financial_facts x WHERE NOT EXISTS (SELECT 1 FROM filings g WHERE g.filing_id = x.filing_id)")
def fact_orphans(t: Read) -> DataFrame:
    return facts.orphans(t("financial_facts"), t("filings")).select(*t("financial_facts").columns)


@query("""SELECT fact_id, filing_id, concept, value, unit, period, dimension, origin FROM financial_facts WHERE fact_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY filing_id NULLS FIRST, concept NULLS FIRST, value NULLS FIRST, unit NULLS FIRST, period NULLS FIRST, dimension NULLS FIRST, origin NULLS FIRST) = 1""")
def fact_first_write_wins(t: Read) -> DataFrame:
    return facts.first_write_wins(t("financial_facts"), None, "fact_id", ["filing_id", "concept", "value", "unit", "period", "dimension", "origin"])


@query("""SELECT filing_id, concept, period, dimension, unit, fact_id, value, origin FROM financial_facts
QUALIFY row_number() OVER (PARTITION BY filing_id, concept, period, dimension, unit ORDER BY fact_id NULLS FIRST, value NULLS FIRST, origin NULLS FIRST) = 1""")
def fact_distinct(t: Read) -> DataFrame:
    return facts.distinct_facts(t("financial_facts"))


@query("SELECT DISTINCT g.collection_id, x.concept FROM financial_facts x JOIN filings g USING (filing_id)")
def concept_index(t: Read) -> DataFrame:
    return facts.concept_index(t("financial_facts"), t("filings"))


@query("""SELECT DISTINCT c.collection_id FROM collections c WHERE c.collection_id IN
(SELECT g.collection_id FROM financial_facts x JOIN filings g USING (filing_id) WHERE x.concept = 'us-gaap:Goodwill')""")
def concept_exists(t: Read) -> DataFrame:
    have = facts.concept_index(t("financial_facts").where("concept = 'us-gaap:Goodwill'"), t("filings"))
    return t("collections").select("collection_id").distinct().join(have, "collection_id", "left_semi")


@query(f"""WITH {FILINGS} SELECT logical_key, filing_id, version FROM one_filing WHERE trim(logical_key) <> ''
QUALIFY row_number() OVER (PARTITION BY logical_key ORDER BY version DESC NULLS LAST, filed_date DESC NULLS LAST, filing_id) = 1""")
def filing_latest_version(t: Read) -> DataFrame:
    return facts.latest_filings(t("filings")).select("logical_key", "filing_id", "version")


@query(f"""WITH {FILINGS}, old AS (SELECT filing_id FROM one_filing WHERE trim(logical_key) <> ''
QUALIFY row_number() OVER (PARTITION BY logical_key ORDER BY version DESC NULLS LAST, filed_date DESC NULLS LAST, filing_id) > 1)
SELECT filing_id, count(*) AS n FROM financial_facts WHERE filing_id IS NULL OR filing_id NOT IN (SELECT filing_id FROM old) GROUP BY filing_id""")
def filing_gc_survivors(t: Read) -> DataFrame:
    kept, _ = facts.collect_garbage(t("financial_facts"), t("filings"))
    return kept.groupBy("filing_id").agg(F.count("*").alias("n"))


@query(f"""SELECT end_year, annual, count(*) AS n, count(DISTINCT filing_id) AS filings FROM
(SELECT filing_id, year({ISO.format(ENDS)}) AS end_year, {ANNUAL} AS annual FROM financial_facts WHERE period IS NOT NULL) GROUP BY ALL""")
def fact_periods(t: Read) -> DataFrame:
    p = F.col("period")
    rows = t("financial_facts").where(p.isNotNull()).select("filing_id", periods.end_year(p).alias("end_year"), periods.is_annual(p).alias("annual"))
    return rows.groupBy("end_year", "annual").agg(F.count("*").alias("n"), F.count_distinct("filing_id").alias("filings"))


@query("""SELECT sha1(concat_ws('|', filing_id, concept, period, coalesce(dimension, ''), unit))[1:16] AS made, count(*) AS n FROM financial_facts GROUP BY ALL""")
def fact_ids(t: Read) -> DataFrame:
    made = tx.fact_id(*[F.col(c) for c in ("filing_id", "concept", "period", "dimension", "unit")])
    return t("financial_facts").groupBy(made.alias("made")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT collection_id, market, status FROM collections), g AS (SELECT DISTINCT filing_id, collection_id FROM filings)
SELECT market, status, count(DISTINCT g.filing_id) AS filings, count(x.fact_id) AS facts FROM f LEFT JOIN g USING (collection_id) LEFT JOIN financial_facts x USING (filing_id) GROUP BY ALL""")
def warehouse_counts(t: Read) -> DataFrame:
    """Filings and facts per market and status, as a generated join over the three tables would count them."""
    c, g = t("collections").select("collection_id", "market", "status").distinct(), t("filings").select("filing_id", "collection_id").distinct()
    per = t("financial_facts").groupBy("filing_id").agg(F.count("fact_id").alias("k"))
    rows = c.join(g.join(per, "filing_id", "left"), "collection_id", "left")
    return rows.groupBy("market", "status").agg(F.count_distinct("filing_id").alias("filings"), F.coalesce(F.sum("k"), F.lit(0)).alias("facts"))


GUARDED = "SELECT x.value FROM financial_facts x JOIN filings g ON x.filing_id = g.filing_id WHERE x.concept = 'us-gaap:Goodwill' AND x.dimension IS NULL LIMIT 500"


@query("""SELECT DISTINCT x.fact_id, x.filing_id, x.concept, x.value, x.unit, x.period, x.dimension, x.origin FROM financial_facts x JOIN filings g ON x.filing_id = g.filing_id
WHERE x.concept = 'us-gaap:Goodwill' AND x.dimension IS NULL ORDER BY ALL NULLS FIRST LIMIT 50""")
def guarded_select(t: Read) -> DataFrame:
    """A generated statement behind the guard: canonical columns, at most 50 rows (the limit is the feature)."""
    views = {name: t(name) for name in sqlguard.TABLES}
    return sqlguard.run(views["filings"].sparkSession, GUARDED, views)


# ---- documents and text


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def ingest_ledger(t: Read) -> DataFrame:
    """Contents with their first document."""
    return t("documents").where("text is not null").groupBy(tx.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT CASE WHEN text IS NULL THEN 'null' WHEN trim(text) = '' THEN 'blank' ELSE 'repeat' END AS reason, count(*) AS n FROM
(SELECT text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE text IS NULL OR trim(text) = '' OR k > 1 GROUP BY ALL""")
def ingest_quarantined(t: Read) -> DataFrame:
    d = t("documents")
    first = d.where("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    none = d.where("text is null").select(F.lit("null").alias("reason"), F.lit(1).alias("n"))
    blank = first.where("trim(text) = ''").select(F.lit("blank").alias("reason"), "n")
    more = first.where("trim(text) <> '' and n > 1").select(F.lit("repeat").alias("reason"), (F.col("n") - 1).alias("n"))
    return none.unionByName(blank).unionByName(more).groupBy("reason").agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id, len({WORDS}) AS n, len(list_distinct({WORDS})) AS kinds FROM documents")
def doc_tokens(t: Read) -> DataFrame:
    w = tx.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds"))


@query(f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY term""")
def doc_term_stats(t: Read) -> DataFrame:
    post = retrieval.postings(t("documents"), "doc_id", "text")
    return post.groupBy("term").agg(F.count_distinct("key").alias("df"), F.sum("tf").alias("tf"))


@query("""WITH lines AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM documents),
cut AS (SELECT doc_id, unnest(string_split(regexp_replace(line, '([.!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s FROM lines WHERE line <> '')
SELECT doc_id, count(*) AS n FROM cut WHERE regexp_replace(s, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY doc_id""")
def sentence_counts(t: Read) -> DataFrame:
    s = F.size(tx.sentences(F.col("text")))
    return t("documents").where("text is not null").select("doc_id", s.cast("bigint").alias("n")).where("n > 0")


@query()
def semantic_segments(t: Read) -> DataFrame:
    """Semantic chunks of the documents over hashed sentence vectors."""
    return chunking.semantic_chunks(t("documents").where("text is not null"), "doc_id", "text")


@query()
def recursive_pieces(t: Read) -> DataFrame:
    return chunking.recursive_chunks(t("documents"), "doc_id", "text")


@query()
def structure_pieces(t: Read) -> DataFrame:
    return chunking.structure_chunks(t("parsed_items"))


@query("""WITH once AS (SELECT item_id, source_doc_id, seq, role FROM parsed_items WHERE trim(coalesce(text, '')) <> '' AND source_doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq) = 1),
numbered AS (SELECT source_doc_id, role, sum((role IN ('title', 'subtitle'))::INT) OVER (PARTITION BY source_doc_id ORDER BY seq, item_id ROWS UNBOUNDED PRECEDING) AS section FROM once)
SELECT source_doc_id, section::INT AS section, count(*) AS items, sum((role = 'table')::INT)::BIGINT AS tables FROM numbered GROUP BY ALL""")
def section_sizes(t: Read) -> DataFrame:
    return chunking.sections(t("parsed_items")).groupBy("source_doc_id", "section").agg(F.count("*").alias("items"), F.count_if(F.col("role") == "table").alias("tables"))


@query("""SELECT chunk_type, count(*) AS n, round(avg((len(coalesce(regexp_extract_all(lower(text), '[a-z0-9]+'), [])) BETWEEN 20 AND 100)::INT), 6) AS share FROM chunks GROUP BY chunk_type""")
def size_compliance(t: Read) -> DataFrame:
    return t("chunks").groupBy("chunk_type").agg(F.count("*").alias("n"), F.round(chunking.size_share(F.size(tx.tokens(F.col("text"))), 20, 100), 6).alias("share"))


@query()
def chunking_gate(t: Read) -> DataFrame:
    """The better of recursive and semantic chunks per document by size, whole sentences, cohesion and coherence."""
    metrics = gate.gate_metrics(t("documents"), "doc_id", "text")
    score = chunking.weighted_gate({m: F.col(m) for m in ("size", "whole", "cohesion", "coherence")})
    return chunking.choose(metrics.select("doc_id", "strategy", F.round(score, 6).alias("score")), "doc_id")


ALPHABET = "etaoinshrd"
LETTERS = "[" + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE" for c in ALPHABET) + "]"


@query(f"""WITH once AS (SELECT chunk_id, metadata.source_doc_id AS key, text FROM chunks WHERE chunk_id IS NOT NULL AND metadata.source_doc_id IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY text) = 1),
c AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY chunk_id) AS ordinal, len({WORDS}) AS size, {LETTERS} AS vector FROM once),
s AS (SELECT *, sum(size) OVER (PARTITION BY key ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS stop FROM c),
p AS (SELECT a.key, a.ordinal AS start, b.vector FROM s a JOIN s b ON a.key = b.key AND b.ordinal >= a.ordinal AND b.stop <= a.stop - a.size + 300),
w AS (SELECT key, start, [{", ".join(f"sum(vector[{k + 1}])" for k in range(len(ALPHABET)))}] AS total FROM p GROUP BY key, start HAVING count(*) >= 2)
SELECT p.key, round(least(greatest(avg(CASE WHEN list_dot_product(p.vector, p.vector) * list_dot_product(total, total) = 0 THEN 0 ELSE list_cosine_similarity(p.vector, total) END), 0), 1), 6) AS coherence FROM p JOIN w ON p.key = w.key AND p.start = w.start GROUP BY p.key""")
def document_coherence(t: Read) -> DataFrame:
    """How close chunks are to the 300 words around them, with counts of letters for vectors."""
    c = t("chunks").select("chunk_id", F.col("metadata.source_doc_id").alias("key"), "text").dropna()
    c = c.groupBy("chunk_id").agg(F.min_by(F.struct("key", "text"), "text").alias("c")).select("chunk_id", "c.*")
    vector = F.array(*[(F.char_length("text") - F.char_length(F.replace("text", F.lit(x), F.lit("")))).cast("double") for x in ALPHABET])
    rows = c.select("key", F.col("chunk_id").alias("ordinal"), F.size(tx.tokens(F.col("text"))).alias("size"), vector.alias("vector"))
    return chunking.coherence(rows, 300).select("key", F.round("coherence", 6).alias("coherence"))


ITEMS = """once AS (SELECT * FROM parsed_items WHERE trim(coalesce(text, '')) <> '' AND source_doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY source_doc_id, seq, role NULLS FIRST, text, level NULLS FIRST, page NULLS FIRST) = 1),
placed AS (SELECT *, coalesce(role IN ('title', 'subtitle'), false) AS heading, sum(coalesce(role IN ('title', 'subtitle'), false)::INT) OVER (PARTITION BY source_doc_id ORDER BY seq, item_id ROWS UNBOUNDED PRECEDING) AS section FROM once)"""


@query(f"""WITH {ITEMS} SELECT source_doc_id, (max(section) - min(section) + 1)::INT AS sections, sum(length(text))::BIGINT AS chars, count(*) FILTER (role = 'table') AS tables FROM placed GROUP BY source_doc_id""")
def parse_counts(t: Read) -> DataFrame:
    """Sections, characters and tables of each parsed document."""
    return chunking.parse_counts(t("parsed_items"))


@query(f"""WITH {ITEMS}, about AS (SELECT source_doc_id, min(page) FILTER (NOT heading) AS cover, min(section) AS first FROM placed GROUP BY ALL),
r AS (SELECT p.*, a.cover FROM placed p JOIN about a USING (source_doc_id) WHERE (p.heading OR a.cover IS NULL OR p.page = a.cover) AND (a.cover IS NOT NULL OR p.section = a.first)),
e AS (SELECT source_doc_id, section, cover, arg_min(text, seq) FILTER (heading) AS title, arg_min(left(trim(text, ' '), 300), (seq, item_id)) FILTER (NOT heading) AS block FROM r GROUP BY ALL HAVING cover IS NULL OR block IS NOT NULL)
SELECT source_doc_id, string_agg(concat_ws(' ' || chr(10) || ' ', title, block), ' ' || chr(10) || ' ' ORDER BY section) AS cover FROM e GROUP BY ALL""")
def cover_texts(t: Read) -> DataFrame:
    """The words on the cover of each parsed document, by which its kind is told."""
    return identity.cover_texts(t("parsed_items"))


@query("""SELECT chunk_id, concat_ws(' · ', nullif(metadata.company_name, ''), nullif(metadata.filing_type, ''), nullif(metadata.fiscal_year::VARCHAR, ''), nullif(metadata.section, '')) AS title,
'/sources/' || metadata.source_doc_id || coalesce('#p' || metadata.page::VARCHAR, '') AS url FROM chunks""")
def source_cards(t: Read) -> DataFrame:
    """Title and address of the source of each chunk."""
    m = lambda c: F.col(f"metadata.{c}")
    title = tx.source_title(m("company_name"), m("filing_type"), F.lit(None).cast("string"), m("fiscal_year"), m("section"))
    return t("chunks").select("chunk_id", title.alias("title"), tx.source_url(m("source_doc_id"), m("page")).alias("url"))


# ---- XBRL

INSTANCE = """concat('<xbrl><context id="c"><period>', if(contains(period, '/'), concat('<startDate>', split_part(period, '/', 1), '</startDate><endDate>', split_part(period, '/', 2), '</endDate>'), concat('<instant>', period, '</instant>')),
'</period>', if(dimension is null, '', concat('<segment><xbrldi:explicitMember dimension="', split_part(dimension, '=', 1), '">', split_part(dimension, '=', 2), '</xbrldi:explicitMember></segment>')), '</context><unit id="u">',
if(contains(unit, '/'), concat('<divide><unitNumerator><measure>iso4217:', split_part(unit, '/', 1), '</measure></unitNumerator><unitDenominator><measure>xbrli:', split_part(unit, '/', 2), '</measure></unitDenominator></divide>'), concat('<measure>iso4217:', unit, '</measure>')),
'</unit><', concept, ' contextRef="c" unitRef="u" decimals="0">', value, '</', concept, '></xbrl>')"""
PLAIN = r"regexp_{0}(period, '^[0-9-]+(/[0-9-]+)?$') AND (dimension IS NULL OR regexp_{0}(dimension, '^[A-Za-z0-9:_-]+=[A-Za-z0-9:_-]+$')) AND regexp_{0}(concept, '^[A-Za-z0-9-]+:[A-Za-z0-9]+$') AND regexp_{0}(unit, '^[A-Za-z]+(/[A-Za-z]+)?$')"


@query(f"""SELECT fact_id, concept, period, dimension, unit, value FROM (SELECT DISTINCT fact_id, concept, period, dimension, unit, value FROM financial_facts WHERE fact_id IS NOT NULL AND value IS NOT NULL AND {PLAIN.format('matches')})
QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY concept, period, unit, dimension NULLS FIRST, value) = 1""")
def xbrl_resolved(t: Read) -> DataFrame:
    """Every fact that is plainly written as an XBRL instance of its own, and read again with period, unit and dimension."""
    f = t("financial_facts").where("fact_id is not null and value is not null").where(PLAIN.format("like"))
    f = f.groupBy("fact_id").agg(F.min(F.struct("concept", "period", "unit", "dimension", "value")).alias("f")).select("fact_id", "f.*")
    out = readers.xbrl_values(f.select("fact_id", F.expr(INSTANCE).alias("x")), "fact_id", "x")
    return out.select("fact_id", "concept", "period", "dimension", "unit", "value")


DEI = """concat('<xbrl><context id="c"><period><instant>2024-01-01</instant></period></context>', coalesce(concat('<dei:EntityCentralIndexKey contextRef="c">', cik, '</dei:EntityCentralIndexKey>'), ''),
coalesce(concat('<dei:DocumentType contextRef="c"> ', filing_type, ' </dei:DocumentType>'), ''), coalesce(concat('<dei:DocumentFiscalYearFocus contextRef="c">', fiscal_year, '</dei:DocumentFiscalYearFocus>'), ''), '</xbrl>')"""


@query(f"""WITH {FILINGS}, k AS (SELECT collection_id, min(cik) AS cik FROM collections WHERE collection_id IS NOT NULL GROUP BY ALL), g AS (SELECT filing_id, nullif(cik, '') AS cik, nullif(trim(filing_type), '') AS filing_type, fiscal_year FROM one_filing JOIN k USING (collection_id))
SELECT filing_id, coalesce('us-cik-' || cik, 'us-' || filing_id) AS collection_id, filing_type, fiscal_year FROM g WHERE cik IS NOT NULL OR filing_type IS NOT NULL OR fiscal_year IS NOT NULL""")
def dei_identified(t: Read) -> DataFrame:
    """Entity facts of the filings, written as instances and read again, as rows of the warehouse."""
    ciks = t("collections").where("collection_id is not null").groupBy("collection_id").agg(F.min("cik").alias("cik"))
    g = facts.one_filing_each(t("filings")).join(ciks, "collection_id").select("filing_id", F.expr(DEI).alias("x"))
    return readers.dei_rows(readers.dei_values(g, "filing_id", "x"), "filing_id").select("filing_id", "collection_id", "filing_type", "fiscal_year")


@query(f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(left(t, 60)) || '…' ELSE t END AS title FROM t""")
def auto_titles(t: Read) -> DataFrame:
    """A title for every text, in any script."""
    rows = t("documents").where("text is not null")
    return rows.select("doc_id", tx.shortened(F.regexp_replace("text", tx.WIDE_SPACE, " "), 60).alias("title"))


# ---- identity


@query("""WITH c AS (SELECT DISTINCT collection_id, company FROM collections WHERE collection_id IS NOT NULL)
SELECT collection_id, company, coalesce(nullif(trim(regexp_replace(lower(company), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM c""")
def company_slugs(t: Read) -> DataFrame:
    rows = t("collections").where("collection_id is not null").select("collection_id", "company").distinct()
    return rows.withColumn("slug", tx.slug(F.col("company")))


@query(f"""WITH {FILINGS} SELECT regexp_replace(upper(filing_type), '/A$', '') AS family,
CASE WHEN regexp_replace(upper(filing_type), '/A$', '') IN ('10-K', '10-Q', '20-F', '40-F', '11-K') THEN 'authoritative' ELSE 'indicative' END AS authority, count(*) AS n FROM one_filing GROUP BY ALL""")
def form_authority(t: Read) -> DataFrame:
    rows = facts.one_filing_each(t("filings")).select(rules.form_family(F.col("filing_type")).alias("family"), rules.authority(F.col("filing_type"), F.lit(None).cast("string")).alias("authority"))
    return rows.groupBy("family", "authority").agg(F.count("*").alias("n"))


KIND = "CASE " + " ".join(f"WHEN lower(cover) LIKE '%{k}%' THEN '{v}'" for k, v in rules.TITLE_RULES) + " END"


@query(f"""SELECT doc_type, kind, count(*) AS n FROM (SELECT doc_type, coalesce({KIND}, 'unknown') AS kind FROM (SELECT doc_type, text AS cover FROM documents WHERE text IS NOT NULL)) GROUP BY ALL""")
def kinds_from_cover(t: Read) -> DataFrame:
    d = t("documents").where("text is not null").withColumnRenamed("doc_type", "labelled")
    found = identity.identify_by_cover(d, "collection_id", "text")
    return found.groupBy(F.col("labelled").alias("doc_type"), F.col("doc_type").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {FILINGS}, c AS (SELECT collection_id, min(company) AS company FROM collections GROUP BY collection_id), f AS (SELECT g.*, c.company, regexp_replace(upper(g.filing_type), '/A$', '') AS family FROM one_filing g JOIN c USING (collection_id))
SELECT filing_id, family AS doc_type, CASE WHEN family IN ('10-K', '10-Q', '20-F', '40-F', '11-K') THEN 'authoritative' ELSE 'indicative' END AS numeric_authority,
concat_ws('|', coalesce(nullif(trim(regexp_replace(lower(company), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown'), coalesce(family, 'exhibit'), concat_ws(' ', nullif(fiscal_period, ''), 'FY' || fiscal_year::VARCHAR)) AS key,
CASE WHEN family IS NULL THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS confidence, family IS NULL AS needs_review FROM f""")
def us_identity(t: Read) -> DataFrame:
    rows = facts.one_filing_each(t("filings")).join(t("collections").groupBy("collection_id").agg(F.min("company").alias("company")), "collection_id")
    return identity.identify_us(rows).select("filing_id", "doc_type", "numeric_authority", "key", "confidence", "needs_review")


@query("""SELECT CASE lower(regexp_extract(source_url, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'htm' THEN 'html' WHEN 'html' THEN 'html' WHEN 'xml' THEN 'xml' WHEN 'xsd' THEN 'xml' WHEN 'txt' THEN 'text' ELSE 'unknown' END AS format, count(*) AS n
FROM filings WHERE source_url IS NOT NULL GROUP BY ALL""")
def source_formats(t: Read) -> DataFrame:
    rows = t("filings").where("source_url is not null")
    return rows.groupBy(rules.format_of(readers.media_type(F.col("source_url"))).alias("format")).agg(F.count("*").alias("n"))


@query("""SELECT 'ObjectCreated:Put' AS event_name, lower(market) AS bucket, 'a b/' || filing_id || '+x.htm' AS key, length(filing_id)::BIGINT AS size, g.filing_id AS etag
FROM (SELECT DISTINCT filing_id, collection_id FROM filings WHERE filing_id IS NOT NULL) g JOIN (SELECT DISTINCT collection_id, market FROM collections) c USING (collection_id)""")
def notifications_decoded(t: Read) -> DataFrame:
    """Bucket notifications made from the filings, and decoded again."""
    g = t("filings").select("filing_id", "collection_id").where("filing_id is not null").distinct()
    g = g.join(t("collections").select("collection_id", "market").distinct(), "collection_id")
    key = F.concat(F.lit("a+b/"), F.col("filing_id"), F.lit("%2Bx.htm"))
    body = F.struct(
        F.array(
            F.struct(
                F.lit("ObjectCreated:Put").alias("eventName"),
                F.struct(F.struct(F.lower("market").alias("name")).alias("bucket"), F.struct(key.alias("key"), F.char_length("filing_id").cast("bigint").alias("size"), F.col("filing_id").alias("eTag")).alias("object")).alias("s3"),
            )
        ).alias("Records")
    )
    return readers.notifications(g.select(F.to_json(body).alias("value"))).where("error is null").select("event_name", "bucket", "key", "size", "etag")


# ---- retrieval

EVAL = "q AS (SELECT item_id AS query, text FROM eval_items WHERE kind = 'question')"
BM25 = f"""{EVAL}, docs AS (SELECT doc_id AS key, {WORDS} AS w FROM documents), post AS (SELECT key, len(w) AS length, term, count(*) AS tf FROM (SELECT key, w, unnest(w) AS term FROM docs) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs), idf0 AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, tot GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
asked AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest({WORDS}) AS term FROM q) GROUP BY ALL),
lex AS (SELECT query, key, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM post JOIN asked USING (term) JOIN idf USING (term), tot GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM lex QUALIFY rank <= 20)"""
SPARSE = """dots AS (SELECT query, key, sum(times * tf)::DOUBLE AS score FROM post JOIN asked USING (term) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM dots QUALIFY rank <= 20)"""


def _asked(t: Read) -> DataFrame:
    return t("eval_items").where("kind = 'question'").select(F.col("item_id").alias("query"), "text")


@query(f"WITH {BM25} SELECT query, key, score, rank::INT AS rank FROM lexical")
def bm25_topk(t: Read) -> DataFrame:
    return retrieval.bm25(t("documents"), _asked(t), "doc_id", "text").select("query", "key", "score", "rank")


@query(f"WITH {BM25}, {SPARSE} SELECT query, key, score, rank::INT AS rank FROM sparse")
def sparse_topk(t: Read) -> DataFrame:
    return retrieval.sparse(t("documents"), _asked(t), "doc_id", "text").select("query", "key", "score", "rank")


@query(f"""WITH {BM25}, {SPARSE}, fused AS (SELECT query, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, key, rank FROM lexical UNION ALL SELECT query, key, rank FROM sparse) GROUP BY ALL)
SELECT query, key, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, key))::INT AS rank FROM fused QUALIFY rank <= 20""")
def rrf_fused(t: Read) -> DataFrame:
    arms = [retrieval.bm25(t("documents"), _asked(t), "doc_id", "text"), retrieval.sparse(t("documents"), _asked(t), "doc_id", "text")]
    return retrieval.fuse(arms).select("query", "key", "score", "rank")


@query()
def scoped_fused(t: Read) -> DataFrame:
    """Messages that name a company, answered from its chunks: both arms fused, old versions dropped."""
    asked = written(chat.one_message_each(t("chat_messages")).where("text is not null").select("id", "text"))
    named = facts.companies_named(asked, t("collections")).withColumnRenamed("id", "query")
    return retrieval.fused_search(t("chunks"), asked.select(F.col("id").alias("query"), "text"), named)


@query("""WITH p AS (SELECT q.vec_id AS query, e.vec_id AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
SELECT query, key, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, key))::INT AS rank FROM p QUALIFY rank <= 10""")
def dense_topk(t: Read) -> DataFrame:
    """Every row whose id is divisible by 20 against all rows."""
    e = t("embeddings")
    return retrieval.dense(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))).select("query", "key", "score", "rank")


@query("""WITH d AS (SELECT label, k, avg(embedding[k]::DOUBLE) AS m FROM embeddings, range(1, 65) r(k) GROUP BY ALL),
m AS (SELECT label, list(m ORDER BY k) AS mean FROM d GROUP BY label)
SELECT e.label, count(*) AS n, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], m.mean)), 5) AS cohesion FROM embeddings e JOIN m USING (label) GROUP BY e.label""")
def label_cohesion(t: Read) -> DataFrame:
    """Mean cosine of vectors with the mean of their label."""
    e = t("embeddings").where("embedding is not null and label is not null")
    one = e.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = one.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mean"))
    return e.join(mean, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cosine(F.col("embedding"), F.col("mean"))), 5).alias("cohesion"))


@query("""WITH k AS (SELECT chunk_id, trim(metadata.logical_key) AS k, metadata.source_revision AS r FROM chunks), top AS (SELECT k, max(r) AS r FROM k WHERE k <> '' GROUP BY k)
SELECT k.chunk_id, k.k AS logical_key, k.r AS revision FROM k LEFT JOIN top ON k.k = top.k WHERE k.k IS NULL OR k.k = '' OR k.r IS NOT DISTINCT FROM top.r""")
def reconcile_latest(t: Read) -> DataFrame:
    kept = retrieval.latest_versions(t("chunks"), F.col("metadata.logical_key"), F.col("metadata.source_revision"))
    return kept.select("chunk_id", F.trim("metadata.logical_key").alias("logical_key"), F.col("metadata.source_revision").alias("revision"))


@query("SELECT chunk_id, chunk_type FROM chunks WHERE metadata.access_tags IS NULL OR len(metadata.access_tags) = 0 OR list_has_any(metadata.access_tags, ['legal', 'public'])")
def access_filtered(t: Read) -> DataFrame:
    return t("chunks").where(retrieval.may_see(F.col("metadata.access_tags"), ["legal", "public"])).select("chunk_id", "chunk_type")


@query("SELECT chunk_id, metadata.fiscal_year AS fiscal_year FROM chunks WHERE metadata.market = 'US' AND metadata.filing_type = '10-K'")
def metadata_filtered(t: Read) -> DataFrame:
    return t("chunks").where(retrieval.matches({"market": "US", "filing_type": "10-K"})).select("chunk_id", F.col("metadata.fiscal_year").alias("fiscal_year"))


@query("SELECT chunk_id, chunk_type FROM chunks WHERE NOT coalesce(metadata.market = 'IN' AND metadata.fiscal_year = 2020, false)")
def vectors_deleted(t: Read) -> DataFrame:
    return retrieval.delete_where(t("chunks"), {"market": "IN", "fiscal_year": 2020}).select("chunk_id", "chunk_type")


@query("""SELECT chunk_id, text, chunk_type FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY metadata.source_revision DESC NULLS LAST, text DESC NULLS LAST, chunk_type DESC NULLS LAST) = 1""")
def vectors_upserted(t: Read) -> DataFrame:
    """The chunks written one after another by revision: the last write of an id stays."""
    c = t("chunks").select("chunk_id", "text", "chunk_type", F.col("metadata.source_revision").alias("revision"))
    return facts.last_write_wins(c.limit(0), c, "chunk_id", [F.col("revision"), F.col("text"), F.col("chunk_type")]).select("chunk_id", "text", "chunk_type")


FLAT = "regexp_replace(coalesce(text, ''), '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g')"


@query(f"""WITH {BM25}, h AS (SELECT query, rank, trim({FLAT}, ' ') AS t FROM lexical JOIN documents ON key = doc_id WHERE rank <= 5)
SELECT query, string_agg('[' || rank::VARCHAR || '] ' || CASE WHEN length(t) > 240 THEN rtrim(left(t, 240), ' ') || '…' ELSE t END, chr(10) ORDER BY rank) AS prompt FROM h GROUP BY query""")
def answer_prompts(t: Read) -> DataFrame:
    """Numbered sources for each question."""
    hits = retrieval.bm25(t("documents"), _asked(t), "doc_id", "text")
    return retrieval.numbered_sources(hits, t("documents"), "doc_id", "text")


@query(f"""WITH {BM25}, h AS (SELECT l.query, key, rank AS old, list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')) AS want, coalesce(regexp_extract_all(lower(d.text), '[a-z0-9]+'), []) AS has FROM lexical l JOIN q USING (query) JOIN documents d ON key = doc_id),
s AS (SELECT query, key, old, round(1 / (1 + exp(-CASE WHEN len(want) = 0 THEN 0 ELSE len(list_intersect(want, has)) / len(want) END)), 9) AS score FROM h)
SELECT query, key, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, old, key))::INT AS rank FROM s QUALIFY rank <= 5""")
def reranked(t: Read) -> DataFrame:
    """The lexical candidates of each question, scored again."""
    hits = retrieval.bm25(t("documents"), _asked(t), "doc_id", "text")
    return answering.rerank(hits, _asked(t), t("documents"), "doc_id", "text")


BARE = "regexp_replace({0}, '^[\\t\\n\\x0b\\f\\r ]+|[\\t\\n\\x0b\\f\\r ]+$', '', 'g')"
LINE = f"list_filter(list_transform(string_split(d.text, chr(10)), lambda x: {BARE.format('x')}), lambda x: x <> '')[1]"
FIRST = f"nullif({BARE.format(f"string_split(regexp_replace({LINE}, '([.!?])[\\t\\n\\x0b\\f\\r ]+([A-Z\"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1]")}, '')"
VERIFIED = f"""tried AS (SELECT l.query, l.key AS cited, l.rank::INT AS tries, {FIRST} || ' [' || l.rank::VARCHAR || ']' AS answer, d.text AS evidence FROM lexical l JOIN documents d ON l.key = d.doc_id WHERE l.rank <= {answering.ATTEMPTS}),
nums AS (SELECT *, regexp_extract_all(regexp_replace(answer, '\\[\\d+\\]', ' ', 'g'), '(\\d[\\d,]*(?:\\.\\d+)?)', 1) AS nums FROM tried WHERE answer IS NOT NULL),
g AS (SELECT *, round(CASE WHEN len(nums) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(nums, lambda x: contains(evidence, x))) / len(nums) END, 6) AS grounding FROM nums),
best AS (SELECT * FROM g WHERE tries = 1 OR query NOT IN (SELECT query FROM g WHERE tries = 1 AND grounding >= {answering.BAR}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY grounding DESC, tries) = 1),
verified AS (SELECT q.query, CASE WHEN grounding >= {answering.BAR} THEN answer ELSE '{answering.ABSTAIN}' END AS answer, CASE WHEN grounding >= {answering.BAR} THEN cited END AS cited, CASE WHEN grounding >= {answering.BAR} THEN grounding ELSE 0.0::DOUBLE END AS grounding, coalesce(tries, 0) AS tries FROM q LEFT JOIN best USING (query))"""


@query(f"WITH {BM25}, {VERIFIED} SELECT * FROM verified")
def answers_verified(t: Read) -> DataFrame:
    """Extracted answers of the questions, checked against their evidence, with a second attempt where the first fails."""
    hits = cut_lineage(retrieval.bm25(t("documents"), _asked(t), "doc_id", "text"))
    return answering.verified(_asked(t), lambda left, n: answering.extract(left, hits, t("documents"), "doc_id", "text", n))


@query()
def chunk_cohesion(t: Read) -> DataFrame:
    """Mean cosine of sentences with their semantic chunk, per document."""
    cut = chunking.semantic_cuts(chunking.sentence_vectors(t("documents").where("text is not null"), "doc_id", "text"))
    parts = cut.groupBy("key", F.col("segment").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    one = answering.embed(cut.select(F.struct("key", "segment", "pos").alias("id"), "sentence"), "id", "sentence")
    whole = answering.embed(parts.select(F.struct("key", "chunk").alias("id"), "text"), "id", "text")
    return chunking.cohesion(one.select("id.key", F.col("id.segment").alias("chunk"), "vector"), whole.select("id.key", "id.chunk", "vector"))


@query(f"""WITH {BM25}, {VERIFIED}, m AS (SELECT query, unnest(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::INT))) AS rank FROM verified)
SELECT DISTINCT m.query, l.key FROM m JOIN lexical l ON m.query = l.query AND m.rank = l.rank""")
def answer_citations(t: Read) -> DataFrame:
    """Sources that the numbered answers cite, out of their hits."""
    hits = cut_lineage(retrieval.bm25(t("documents"), _asked(t), "doc_id", "text"))
    answers = answering.verified(_asked(t), lambda left, n: answering.extract(left, hits, t("documents"), "doc_id", "text", n))
    return answering.kept_citations(answers, hits)


@query("""WITH c AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL), h AS (SELECT chunk_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM c)
SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point FROM h""")
def point_ids(t: Read) -> DataFrame:
    """The ids under which chunks are stored in a vector index."""
    return t("chunks").where("chunk_id is not null").select("chunk_id").distinct().withColumn("point", tx.point_id(F.col("chunk_id")))


# ---- questions, chat, guards


def _whole_words(p: str) -> str:
    return f"regexp_matches(lower(text), '(?:^|[^a-z0-9_]){p}(?:[^a-z0-9_]|$)')"


METRIC = "CASE " + " ".join(f"WHEN {_whole_words(p)} THEN '{rules.PHRASES[p]}'" for p in sorted(rules.PHRASES, key=len, reverse=True)) + " END"
YEAR = "try_cast(nullif(regexp_extract(lower(text), '(?:^|[^a-z0-9_])(?:fy\\s?|fiscal\\s+)?((?:19|20)[0-9]{2})(?:[^a-z0-9_]|$)', 1), '') AS INT)"


@query(f"""WITH {MESSAGES} SELECT metric, year, path, count(*) AS n FROM (SELECT {METRIC} AS metric, {YEAR} AS year, CASE WHEN {METRIC} IS NOT NULL OR regexp_matches(lower(text), '{"|".join(rules.FACT_TERMS)}') THEN 'exact' ELSE 'narrative' END AS path FROM one_message WHERE text IS NOT NULL) GROUP BY ALL""")
def questions_routed(t: Read) -> DataFrame:
    text = F.col("text")
    rows = chat.one_message_each(t("chat_messages")).where("text is not null").select(rules.metric_named(text).alias("metric"), periods.year_named(text).alias("year"), rules.route(text).alias("path"))
    return rows.groupBy("metric", "year", "path").agg(F.count("*").alias("n"))


CORE = "trim(replace(lower(company), ',', ''))"
for _s in facts.SUFFIXES:
    CORE = f"regexp_replace({CORE}, ' {_s}$', '')"


NAMED = f"""w AS (SELECT DISTINCT id, unnest(regexp_split_to_array(regexp_replace(lower(text), '''s|,', ' ', 'g'), '\\s+')) AS word FROM one_message WHERE text IS NOT NULL),
n AS (SELECT regexp_extract(trim({CORE}), '^\\S+') AS word, 1 AS phase, collection_id FROM collections WHERE company IS NOT NULL),
k AS (SELECT lower(ticker) AS word, 0 AS phase, collection_id FROM collections UNION ALL SELECT * FROM n WHERE length(word) > 2),
named AS (SELECT w.id, k.collection_id FROM w JOIN k ON w.word = k.word WHERE w.word <> '' QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY k.phase, k.collection_id) = 1)"""


@query(f"WITH {MESSAGES}, {NAMED} SELECT * FROM named")
def companies_mentioned(t: Read) -> DataFrame:
    asked = chat.one_message_each(t("chat_messages")).where("text is not null")
    return facts.companies_named(asked, t("collections"))


CHOICES = ", ".join(f"('{m}', '{c}', {k})" for m, cs in rules.METRICS.items() for k, c in enumerate(cs))


@query(f"""WITH {MESSAGES}, {FILINGS}, {NAMED}, asked AS (SELECT id, {METRIC} AS metric, collection_id, {YEAR} AS year FROM one_message JOIN named USING (id) WHERE metric IS NOT NULL),
wanted AS (SELECT * FROM asked JOIN (VALUES {CHOICES}) v(metric, concept, choice) USING (metric)),
usable AS (SELECT g.collection_id, x.*, {ANNUAL} AS annual, {ENDS} AS ends, year({ISO.format(ENDS)}) AS end_year FROM financial_facts x JOIN one_filing g USING (filing_id) WHERE x.dimension IS NULL AND x.period IS NOT NULL),
top AS (SELECT id, metric, collection_id, year, concept, value, unit, period, end_year FROM wanted JOIN usable USING (collection_id, concept) WHERE year IS NULL OR year = end_year
QUALIFY row_number() OVER (PARTITION BY id ORDER BY choice, annual DESC, ends DESC, fact_id NULLS FIRST, value) = 1)
SELECT id, metric, collection_id, year, concept, value, unit, period, metric || ' for ' || coalesce('FY' || end_year::VARCHAR, period) || ': ' ||
CASE WHEN unit = 'USD' THEN '$' ELSE '' END || CASE WHEN value = floor(value) THEN format('{{:,.0f}}', value) ELSE format('{{:,.2f}}', value) END || CASE WHEN unit = 'USD' OR unit IS NULL THEN '' ELSE ' ' || unit END AS answer FROM top""")
def structured_answers(t: Read) -> DataFrame:
    """Exact answers to the users' questions."""
    asked = chat.one_message_each(t("chat_messages")).where("text is not null").select("id", "text")
    return facts.answer_questions(asked, t("financial_facts"), t("filings"), t("collections"))


@query(f"""WITH {MESSAGES}, last AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS back FROM one_message WHERE session_id IS NOT NULL AND created_at IS NOT NULL QUALIFY back <= 6)
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY back DESC))::INT AS turn, id, role, text FROM last""")
def recent_turns(t: Read) -> DataFrame:
    return chat.recent_turns(t("chat_messages"))


@query("""WITH s AS (SELECT * FROM chat_sessions QUALIFY row_number() OVER (PARTITION BY id ORDER BY user_id NULLS FIRST, title NULLS FIRST, created_at NULLS FIRST, updated_at NULLS FIRST) = 1)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, id))::INT AS place, id, title FROM s QUALIFY place <= 100""")
def session_list(t: Read) -> DataFrame:
    return chat.session_list(t("chat_sessions"))


@query(f"""WITH {MESSAGES} SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY created_at NULLS FIRST, id))::INT AS place, id, role, text FROM one_message WHERE session_id IS NOT NULL""")
def transcripts(t: Read) -> DataFrame:
    """Every message of every session in the order in which it was said."""
    return chat.transcript(t("chat_messages"))


CLAIMS = """one_message AS (SELECT * FROM chat_messages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST) = 1),
c AS (SELECT id, text AS answer, coalesce(meta, '') AS evidence, 'CONFIDENCE: 0.' || (length(text) % 10)::VARCHAR || chr(10) || 'UNSUPPORTED: ' || (length(text) % 4)::VARCHAR AS reply FROM one_message WHERE contains(text, '['))"""


@query(f"""WITH {CLAIMS}, m AS (SELECT *, list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::INT)) AS marks, regexp_extract_all(regexp_replace(answer, '\\[\\d+\\]', ' ', 'g'), '(\\d[\\d,]*(?:\\.\\d+)?)', 1) AS nums FROM c)
SELECT id, round(least(CASE WHEN len(nums) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(nums, lambda x: contains(evidence, x))) / len(nums) END, ('0.' || (length(answer) % 10)::VARCHAR)::DOUBLE), 6) AS confidence,
coalesce(array_to_string(list_sort(list_filter(marks, lambda x: x <> length(answer) % 4)), ','), '') AS citations FROM m""")
def citations_verified(t: Read) -> DataFrame:
    """The replies' claims against their sources in meta, with a verdict derived from the reply's length in place of a judge."""
    m = chat.one_message_each(t("chat_messages")).where(F.col("text").contains("["))
    size = F.char_length("text")
    reply = F.concat(F.lit("CONFIDENCE: 0."), (size % 10).cast("string"), F.lit("\nUNSUPPORTED: "), (size % 4).cast("string"))
    out = answering.citations_verified(m.select("id", F.col("text").alias("answer"), F.coalesce("meta", F.lit("")).alias("evidence"), reply.alias("reply")))
    return out.select("id", "confidence", F.array_join(F.array_sort("citations"), ",").alias("citations"))


def _guard_sql(rows: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join("WHEN regexp_matches(text, '{}', 'i') THEN '{}'".format(p.replace("'", "''"), c) for c, p in rows) + " END"


@query(f"""WITH {MESSAGES} SELECT {_guard_sql(rules.INPUT_RULES)} AS input_category, {_guard_sql(rules.OUTPUT_RULES)} AS output_category, count(*) AS n FROM one_message WHERE text IS NOT NULL GROUP BY ALL""")
def guard_flags(t: Read) -> DataFrame:
    rows = chat.guarded(chat.one_message_each(t("chat_messages")).where("text is not null"))
    return rows.groupBy("input_category", "output_category").agg(F.count("*").alias("n"))


@query(f"""WITH {MESSAGES}, m AS (SELECT id, list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: x::INT) AS marks FROM one_message WHERE text IS NOT NULL)
SELECT id, len(marks) AS n, len(list_distinct(marks)) AS sources, list_max(marks) AS highest FROM m WHERE len(marks) > 0""")
def citation_marks(t: Read) -> DataFrame:
    m = chat.one_message_each(t("chat_messages")).where("text is not null").select("id", tx.citation_markers(F.col("text")).alias("marks"))
    return m.where(F.size("marks") > 0).select("id", F.size("marks").alias("n"), F.size(F.array_distinct("marks")).alias("sources"), F.array_max("marks").alias("highest"))


SIDE = f"CASE WHEN {{0}} IN {rules.USER} THEN 'user' WHEN {{0}} IN {rules.ASSISTANT} THEN 'assistant' END".format("lower(regexp_replace(role, '^[\\s\\x{A0}:]+|[\\s\\x{A0}:]+$', '', 'g'))")


@query(f"""WITH {MESSAGES}, m AS (SELECT *, {SIDE} AS side FROM one_message), s AS (SELECT session_id, string_agg(text, ' ' ORDER BY id) AS evidence FROM m WHERE side = 'user' AND text IS NOT NULL GROUP BY session_id),
a AS (SELECT m.id, regexp_extract_all(regexp_replace(m.text, '\\[\\d+\\]', ' ', 'g'), '(\\d[\\d,]*(?:\\.\\d+)?)', 1) AS nums, s.evidence FROM m JOIN s USING (session_id) WHERE m.side = 'assistant' AND m.text IS NOT NULL)
SELECT id, len(nums) AS figures, round(CASE WHEN len(nums) = 0 THEN 1.0 ELSE len(list_filter(nums, lambda x: contains(evidence, x))) / len(nums) END, 6) AS grounding FROM a""")
def numeric_grounding(t: Read) -> DataFrame:
    """How far the figures of replies stand in the questions of their session."""
    return chat.numeric_grounding(t("chat_messages"))


@query(f"""WITH {MESSAGES} SELECT id, len(regexp_extract_all(text, '{redaction.FORMS["EMAIL"]}')) AS n FROM one_message WHERE regexp_matches(text, '{redaction.FORMS["EMAIL"]}')""")
def email_counts(t: Read) -> DataFrame:
    """Mail addresses of each message, with word ends as in ASCII whatever the script."""
    m = chat.one_message_each(t("chat_messages")).where(F.col("text").contains("@"))
    form = redaction.FORMS["EMAIL"].replace(r"\b", tx.ASCII_WORD_END)
    return m.select("id", F.size(F.regexp_extract_all("text", F.lit(f"({form})"), 1)).alias("n")).where("n > 0")


@query()
def identifiers_masked(t: Read) -> DataFrame:
    return redaction.mask(chat.one_message_each(t("chat_messages")), "id", "text")


@query("""WITH n AS (SELECT chunk_id, replace(unnest(regexp_extract_all(text, '[0-9]{4}-?[0-9]{4}-?[0-9]{4}-?[0-9]{4}')), '-', '') AS d FROM chunks),
s AS (SELECT chunk_id, d, list_sum(list_transform(range(1, 17), lambda k: CASE WHEN k % 2 = 0 THEN d[k]::INT ELSE (2 * d[k]::INT) // 10 + (2 * d[k]::INT) % 10 END)) AS total FROM n)
SELECT chunk_id, d AS number, total % 10 = 0 AS valid FROM s""")
def card_checks(t: Read) -> DataFrame:
    rows = t("chunks").select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{4}-?[0-9]{4}-?[0-9]{4}-?[0-9]{4})"), 1)).alias("d"))
    return rows.select("chunk_id", F.replace("d", F.lit("-"), F.lit("")).alias("number")).withColumn("valid", checksums.luhn(F.col("number")))


def _pentagon(a: int, b: int) -> int:
    """Product of two symmetries of a pentagon, as maps of its corners: k turns by k, 5 + k turns and then flips."""
    move = lambda s, x: (x + s) % 5 if s < 5 else (s - 5 - x) % 5
    both = [move(a, move(b, x)) for x in range(5)]
    return next(s for s in range(10) if [move(s, x) for x in range(5)] == both)


_turns = [list(range(10))]
for _ in range(7):
    _turns.append([(1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[x] for x in _turns[-1]])


@query(f"""WITH n AS (SELECT id, regexp_replace(unnest(regexp_extract_all(text, '([2-9][0-9]{{3}}[- ]?[0-9]{{4}}[- ]?[0-9]{{4}})', 1)), '[- ]', '', 'g') AS number FROM chat_messages),
t AS (SELECT id, number, list_transform(range(0, 12), lambda k: {_turns}[k % 8 + 1][number[12 - k]::INT + 1]) AS turned FROM n)
SELECT id, number, list_reduce(list_prepend(0, turned), lambda a, x: {[[_pentagon(a, b) for b in range(10)] for a in range(10)]}[a + 1][x + 1]) = 0 AS valid FROM t""")
def aadhaar_checks(t: Read) -> DataFrame:
    """Twelve-digit numbers of messages with the verdict on their check digit."""
    rows = t("chat_messages").select("id", F.explode(F.regexp_extract_all("text", F.lit("([2-9][0-9]{3}[- ]?[0-9]{4}[- ]?[0-9]{4})"), 1)).alias("d"))
    return rows.select("id", F.regexp_replace("d", "[- ]", "").alias("number")).withColumn("valid", checksums.verhoeff(F.col("number")))


# ---- events, traces, evaluation

STAGE = "CASE event_type WHEN 'view' THEN 'detect' WHEN 'click' THEN 'parse' WHEN 'signup' THEN 'chunk' WHEN 'purchase' THEN 'embed' ELSE 'index' END"
STATUS = "CASE event_type WHEN 'error' THEN 'failed' ELSE CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'done' WHEN 2 THEN 'deferred' ELSE 'skipped' END END"
PLACE = "CASE status WHEN 'running' THEN 1 WHEN 'failed' THEN 2 WHEN 'done' THEN 3 WHEN 'deferred' THEN 4 ELSE 5 END"


def _stages(t: Read) -> DataFrame:
    return t("events").select("user_id", "event_id", F.expr(STAGE).alias("stage"), F.expr(STATUS).alias("status"))


@query(f"""SELECT user_id, stage, min(event_id) AS first_seq, arg_max(status, event_id) AS status FROM (SELECT user_id, event_id, {STAGE} AS stage, {STATUS} AS status FROM events) GROUP BY ALL""")
def latest_stage(t: Read) -> DataFrame:
    return monitor.latest_stages(_stages(t), "user_id", "stage", "status", "event_id")


@query(f"""WITH s AS (SELECT user_id, stage, arg_max(status, event_id) AS status FROM (SELECT user_id, event_id, {STAGE} AS stage, {STATUS} AS status FROM events) GROUP BY ALL)
SELECT user_id % 10 AS upload, stage, ['running', 'failed', 'done', 'deferred', 'skipped'][min({PLACE})] AS status FROM s GROUP BY ALL""")
def macro_status(t: Read) -> DataFrame:
    latest = monitor.latest_stages(_stages(t), "user_id", "stage", "status", "event_id").withColumn("upload", F.col("user_id") % 10)
    return monitor.macro_status(latest, "upload", "stage", "status")


KINDS = "CASE event_type WHEN 'signup' THEN 'upload' WHEN 'purchase' THEN 'done' ELSE 'node' END"


@query(f"""WITH e AS (SELECT user_id, event_id, {KINDS} AS kind, {STAGE} AS stage, {STATUS} AS status FROM events), r AS (SELECT user_id, max(event_id) AS reset FROM e WHERE kind = 'upload' GROUP BY ALL)
SELECT user_id, arg_max(stage, event_id) FILTER (kind = 'node') AS stage, arg_max(status, event_id) FILTER (kind = 'node') AS status, arg_max(status, event_id) FILTER (kind = 'done') AS outcome
FROM r LEFT JOIN e USING (user_id) WHERE e.event_id >= reset GROUP BY user_id""")
def monitor_states(t: Read) -> DataFrame:
    """Latest stage and outcome of each unit since its last upload."""
    e = t("events").select("user_id", "event_id", F.expr(KINDS).alias("kind"), F.expr(STAGE).alias("stage"), F.expr(STATUS).alias("status"))
    return monitor.folded_states(e, "user_id", "kind", "event_id", "stage", "status", "status")


@query(f"""WITH e AS (SELECT user_id, event_id, {KINDS} AS kind, {STAGE} AS stage, {STATUS} AS status FROM events),
s AS (SELECT user_id, stage, min(event_id) AS first_seq, arg_max(status, event_id) AS status FROM e GROUP BY ALL), tr AS (SELECT user_id, string_agg(stage || ':' || status, ',' ORDER BY first_seq) AS trace FROM s GROUP BY ALL),
d AS (SELECT user_id, user_id % 500 AS upload_id, max(event_id) AS created, arg_max(stage, event_id) FILTER (kind = 'node') AS stage, arg_max(status, event_id) FILTER (kind = 'done') AS outcome FROM e GROUP BY ALL),
u AS (SELECT upload_id, (row_number() OVER (ORDER BY max(created) DESC, upload_id))::INT AS place FROM d GROUP BY upload_id QUALIFY place <= 100)
SELECT upload_id, place, user_id AS doc_id, coalesce(outcome, CASE WHEN stage IS NOT NULL THEN 'processing' ELSE 'pending' END) AS status, coalesce(trace, '') AS trace FROM d JOIN u USING (upload_id) LEFT JOIN tr USING (user_id)""")
def uploads_traced(t: Read) -> DataFrame:
    """The hundred latest uploads with their documents and stages."""
    e = t("events").select("user_id", "event_id", F.expr(KINDS).alias("kind"), F.expr(STAGE).alias("stage"), F.expr(STATUS).alias("status"))
    of = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.col("event_id")))
    d = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.max("event_id").alias("created"), of("node", "stage").alias("stage"), of("done", "status").alias("outcome")).withColumn("upload_id", F.col("doc_id") % 500)
    trace = monitor.latest_stages(e, "user_id", "stage", "status", "event_id").withColumnRenamed("user_id", "doc_id")
    return monitor.uploads_traced(d, trace)


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling(t: Read) -> DataFrame:
    out = ingest.tumbling(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM
(SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events))
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def events_session(t: Read) -> DataFrame:
    out = ingest.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.select("user_id", F.date_format("start", stamp).alias("start"), F.date_format("end", stamp).alias("end"), "n")


@query("""WITH RECURSIVE up(node, anc) AS (SELECT event_id, event_id FROM events UNION ALL SELECT node, anc // 8 FROM up WHERE anc > 0)
SELECT anc AS event_id, round(sum(e.value), 4) AS total FROM up JOIN events e ON e.event_id = up.node GROUP BY anc""")
def span_rollup(t: Read) -> DataFrame:
    """The events as a tree of spans (event n hangs below n // 8), with the value of each subtree."""
    spans = t("events").select("event_id", F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 8)).alias("parent"), "value")
    return monitor.subtree_sums(spans, "event_id", "parent", "value").select("event_id", F.round("total", 4).alias("total"))


SCRIPT = "CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' WHEN regexp_matches(lower(text), ' (und|der|die) ') THEN 'de' WHEN regexp_matches(lower(text), ' (les|des|une) ') THEN 'fr' WHEN regexp_matches(lower(text), ' (não|uma|da) ') THEN 'pt' WHEN regexp_matches(lower(text), ' (el|los|las) ') THEN 'es' ELSE 'en' END"


def _cases(t: Read) -> DataFrame:
    """Documents as cases of a small language rule: expected is the label, found the rule's answer."""
    d = t("documents").where("text is not null and lang is not null")
    return d.select("doc_type", "lang", F.expr(SCRIPT.replace("regexp_matches(", "regexp_like(")).alias("found"))


@query(f"""SELECT doc_type, lang, count(*) AS n, round(avg((lang = found)::INT), 6) AS accuracy FROM (SELECT doc_type, lang, {SCRIPT} AS found FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) GROUP BY ALL""")
def eval_summary(t: Read) -> DataFrame:
    hit = evaluation.recall(F.array("lang"), F.array("found"))
    return _cases(t).groupBy("doc_type", "lang").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


@query(f"""WITH s AS (SELECT doc_type, round(avg((lang = found)::INT), 6) AS accuracy FROM (SELECT doc_type, lang, {SCRIPT} AS found FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) GROUP BY ALL)
SELECT doc_type, accuracy, (row_number() OVER (ORDER BY coalesce(accuracy, 0) DESC, doc_type NULLS FIRST))::INT AS place FROM s""")
def leaderboard(t: Read) -> DataFrame:
    scores = _cases(t).groupBy("doc_type").agg(F.round(F.avg(evaluation.recall(F.array("lang"), F.array("found"))), 6).alias("accuracy"))
    return evaluation.leaderboard(scores, "doc_type", "accuracy")


MARKED = " OR ".join(f"contains(lower(text), '{m}')" for m in evaluation.MARKUP)


@query(f"""SELECT chunk_type, round(avg((text IS NOT NULL AND trim(text) <> '')::INT), 6) AS filled, round(coalesce(avg(({MARKED})::INT), 0), 6) AS markup FROM chunks GROUP BY chunk_type""")
def chunk_health(t: Read) -> DataFrame:
    """Shares of chunks that hold text, and that hold marks of markup."""
    ok = F.coalesce(F.trim("text") != "", F.lit(False))
    return t("chunks").groupBy("chunk_type").agg(F.round(evaluation.success_rate(ok), 6).alias("filled"), F.round(evaluation.markup_share(F.col("text")), 6).alias("markup"))


@query(f"""WITH {FILINGS}, e AS (SELECT g.filing_id, regexp_replace(upper(filing_type), '/A$', '') AS family, fiscal_period, nullif(upper(trim(split_part(logical_key, '|', 2), ' ')), '') AS want_family, nullif(trim(regexp_extract(split_part(logical_key, '|', 3), '^ *(FY|Q[1-4]|H[12])', 1)), '') AS want_period FROM one_filing g)
SELECT filing_id, round(CASE WHEN want_family IS NULL AND want_period IS NULL THEN 1.0::DOUBLE ELSE (coalesce(family = want_family, false)::INT + coalesce(fiscal_period = want_period, false)::INT) / ((want_family IS NOT NULL)::INT + (want_period IS NOT NULL)::INT) END, 6) AS accuracy FROM e""")
def identity_accuracy(t: Read) -> DataFrame:
    """How far form and period of each filing are those that its logical key names."""
    g = facts.one_filing_each(t("filings"))
    part = lambda n: F.get(F.split("logical_key", r"\|"), F.lit(n))
    fields = [(rules.form_family(F.col("filing_type")), F.nullif(F.upper(F.trim(part(1))), F.lit(""))), (F.col("fiscal_period"), F.nullif(F.regexp_extract(part(2), "^ *(FY|Q[1-4]|H[12])", 1), F.lit("")))]
    return g.select("filing_id", F.round(evaluation.identity_accuracy(fields), 6).alias("accuracy"))


@query("""SELECT status, market, count(*) AS n FROM (SELECT DISTINCT * FROM collections) WHERE contains(lower(company), 'works') OR contains(lower(collection_id), 'foods') OR contains(lower(company), 'co') GROUP BY ALL""")
def corpus_listed(t: Read) -> DataFrame:
    """Companies with a given stretch in name or id, by status and market."""
    rows = t("collections").distinct()
    hit = F.lower("company").contains("works") | F.lower("collection_id").contains("foods") | F.lower("company").contains("co")
    return rows.where(hit).groupBy("status", "market").agg(F.count("*").alias("n"))


@query("""SELECT c.collection_id, string_agg(g.filing_id, ',' ORDER BY g.filed_date DESC NULLS LAST, g.filing_id) AS filings, count(*) AS n FROM (SELECT DISTINCT collection_id FROM collections) c
JOIN (SELECT DISTINCT filing_id, collection_id, filed_date FROM filings WHERE filing_id IS NOT NULL) g USING (collection_id) GROUP BY c.collection_id""")
def filings_nested(t: Read) -> DataFrame:
    """Each company's filings as one ordered list, newest first."""
    g = t("filings").where("filing_id is not null").select("filing_id", "collection_id", "filed_date").distinct()
    g = g.join(t("collections").select("collection_id").distinct(), "collection_id")
    key = F.struct((-F.coalesce(F.unix_date("filed_date"), F.lit(-(2**30)))).alias("k"), "filing_id")
    names = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["filing_id"])
    return g.groupBy("collection_id").agg(F.array_join(names, ",").alias("filings"), F.count("*").alias("n"))


# ---- generated joins over a star schema


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t: Read) -> DataFrame:
    rows = t("lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def supplier_volume(t: Read) -> DataFrame:
    c, o, li, s = t("customer"), t("orders"), t("lineitem"), t("supplier")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, (li.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey))
    rows = rows.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def largest_order(t: Read) -> DataFrame:
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o")
    rows = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(best)
    return rows.join(t("customer").select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", "o.*")
