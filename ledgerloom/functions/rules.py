"""Rule tables of the pipeline as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocking patterns of questions, first match wins.
INPUT_RULES = (
    ("prompt_injection", r"\b(ignore|disregard|forget|override)\b.{0,30}\b(previous|prior|above|earlier|all)\b.{0,20}\b(instruction|prompt|rule|context|message)"),
    ("prompt_exfiltration", r"\b(reveal|show|print|repeat|tell me|what (is|are))\b.{0,30}\b(your )?(system )?(prompt|instructions|guidelines|rules)\b"),
    ("jailbreak", r"\b(developer mode|do anything now|\bDAN\b|jailbreak|without any (restrictions|filters|guardrails)|pretend you (are|have) no (rules|restrictions))\b"),
    ("role_override", r"\byou are now\b.{0,40}\b(unrestricted|uncensored|not an? (ai|assistant))\b"),
)
# Blocking patterns of answers.
OUTPUT_RULES = (
    ("system_prompt_leak", r"you are a financial-analysis assistant|answer the question using only the numbered sources|do not use outside knowledge|cite every claim with its source number"),
    ("instruction_echo", r"\b(my|the) (system )?(prompt|instructions|guidelines) (are|is|say)\b|here (are|is) (my|the) (system )?(prompt|instructions)\b"),
    ("unsafe_content", r"\b(ignore (all|the) (previous|above) instructions|i have been (jailbroken|hacked)|developer mode (enabled|activated))\b"),
)
# Keywords of document kinds, first match wins.
TITLE_RULES = (
    ("annual report", "annual_report"),
    ("investor presentation", "investor_presentation"),
    ("earnings presentation", "investor_presentation"),
    ("transcript", "earnings_call_transcript"),
    ("press release", "press_release"),
    ("financial results", "financial_results"),
    ("results for the quarter", "financial_results"),
    ("results for the year", "financial_results"),
    ("financial statements", "financial_results"),
)
AUTHORITATIVE_FORMS = ("10-K", "10-Q", "20-F", "40-F", "11-K")
AUTHORITATIVE_KINDS = ("annual_report", "financial_results")
# Metrics, their concepts in order of preference, and the phrases that name them.
METRICS = {
    "revenue": ("us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap:Revenues", "us-gaap:SalesRevenueNet"),
    "net income": ("us-gaap:NetIncomeLoss",),
    "gross profit": ("us-gaap:GrossProfit",),
    "operating income": ("us-gaap:OperatingIncomeLoss",),
    "total assets": ("us-gaap:Assets",),
    "diluted eps": ("us-gaap:EarningsPerShareDiluted",),
    "basic eps": ("us-gaap:EarningsPerShareBasic",),
}
PHRASES = {
    "total revenue": "revenue", "net sales": "revenue", "revenue": "revenue", "sales": "revenue",
    "net income": "net income", "net earnings": "net income", "net profit": "net income",
    "gross profit": "gross profit", "operating income": "operating income", "operating profit": "operating income", "total assets": "total assets",
    "diluted eps": "diluted eps", "diluted earnings per share": "diluted eps", "basic eps": "basic eps", "basic earnings per share": "basic eps", "earnings per share": "diluted eps", "eps": "diluted eps",
}
FACT_TERMS = (
    "cash", "debt", "borrowing", "liabilit", "asset", "equity", "dividend", "shares outstanding", "outstanding shares", "capex", "capital expenditure", "inventor", "receivable", "payable", "ebitda", "cash flow",
    "interest expense", "goodwill", "depreciation", "amortization", "retained earnings", "book value", "margin", "expenses",
)
# Media types to coarse formats.
FORMATS = {
    "application/pdf": "pdf", "image/png": "image", "image/jpeg": "image", "image/tiff": "image", "image/bmp": "image", "image/webp": "image", "image/gif": "image",
    "text/html": "html", "application/xhtml+xml": "html", "application/xml": "xml", "text/xml": "xml", "text/plain": "text",
}
# Wordings of the two sides of a chat.
USER = ("user", "usr", "human", "customer", "client", "person", "me", "end user", "end-user", "enduser", "questioner", "prompter")
ASSISTANT = ("assistant", "asst", "ai", "bot", "model", "chatbot", "machine", "agent", "gpt", "llm", "ai assistant", "ai-assistant", "chat bot")
INLINE_XBRL, INSTANCE, LINKBASE = "http://www.xbrl.org/2013/inlinexbrl", "http://www.xbrl.org/2003/instance", "http://www.xbrl.org/2003/linkbase"


def first_rule(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Category of the first pattern that matches anywhere, regardless of case; null if none does."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + p), F.lit(c)) for c, p in rules])


def side(role: Column) -> Column:
    """user, assistant, or null for any other role."""
    r = F.lower(F.regexp_replace(role, r"^[\s\x{A0}:]+|[\s\x{A0}:]+$", ""))
    return F.when(r.isin(*USER), "user").when(r.isin(*ASSISTANT), "assistant")


def verdict(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Struct of allowed, category and reason."""
    c = first_rule(text, rules)
    return F.struct(c.isNull().alias("allowed"), c.alias("category"), F.concat(F.lit("matched a "), F.replace(c, F.lit("_"), F.lit(" ")), F.lit(" pattern")).alias("reason"))


def form_family(form: Column) -> Column:
    return F.regexp_replace(F.upper(form), "/A$", "")


def authority(form: Column, kind: Column) -> Column:
    sure = F.coalesce(form_family(form).isin(*AUTHORITATIVE_FORMS), F.lit(False)) | F.coalesce(kind.isin(*AUTHORITATIVE_KINDS), F.lit(False))
    return F.when(sure, "authoritative").otherwise("indicative")


def kind_from_title(title: Column) -> Column:
    t = F.lower(title)
    return F.coalesce(*[F.when(t.contains(k), F.lit(v)) for k, v in TITLE_RULES])


def metric_named(text: Column) -> Column:
    """The metric of the longest phrase that stands as whole words."""
    t = F.lower(text)
    ordered = sorted(PHRASES, key=len, reverse=True)
    return F.coalesce(*[F.when(t.rlike(rf"(?:^|[^a-z0-9_]){p}(?:[^a-z0-9_]|$)"), F.lit(PHRASES[p])) for p in ordered])


def route(text: Column) -> Column:
    """exact for questions about figures, else narrative."""
    term = F.lower(text).rlike("|".join(FACT_TERMS))
    return F.when(metric_named(text).isNotNull() | term, "exact").otherwise("narrative")


def format_of(media_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(known[F.lower(media_type)], F.lit("unknown"))


def sniffed(data: Column) -> Column:
    """Format of a file from its first bytes; XML and HTML are told apart by their first tags."""
    head = F.hex(F.substring(data, 1, 16))
    text = F.lower(F.decode(F.substring(data, 1, 8192), "ISO-8859-1"))
    body = F.ltrim(F.regexp_replace(text, r"^ï»¿", ""))
    starts = lambda *hexes: reduce(lambda a, b: a | b, [head.startswith(h) for h in hexes])
    return (
        F.when(starts("25504446"), "pdf")
        .when(starts("89504E47", "FFD8FF", "49492A00", "4D4D002A", "424D", "47494638") | head.rlike("^52494646.{8}57454250"), "image")
        .when(body.startswith("<!doctype html") | body.startswith("<html") | body.rlike(r"^<\?xml[^>]*>\s*(?:<!--.*?-->\s*)*(?:<!doctype html[^>]*>\s*)?<html"), "html")
        .when(body.startswith("<?xml") | body.rlike(r"^<[a-z][\w:.-]*[\s>]"), "xml")
        .when((F.octet_length(data) > 0) & ~text.rlike(r"[\x00-\x08\x0e-\x1f]"), "text")
        .otherwise("unknown")
    )


def xbrl_role(data: Column) -> Column:
    """inline, instance, schema or null, from markers in the first 65,536 bytes."""
    head = F.lower(F.decode(F.substring(data, 1, 65536), "ISO-8859-1"))
    schema = head.contains("<xsd:schema") | head.contains("<schema")
    return (
        F.when(head.contains(INLINE_XBRL), "inline")
        .when(head.contains(INSTANCE) & ~head.contains(LINKBASE) & ~schema, "instance")
        .when(schema & head.contains("xbrl"), "schema")
    )
