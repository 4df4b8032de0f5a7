"""Column functions over text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z\"'(])"
#: The word boundary, with letters, digits and underscores of ASCII as words; engines differ in \b beyond ASCII.
ASCII_WORD_END = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: White space beyond ASCII, as in Python's split().
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def tokens(text: Column) -> Column:
    """Runs of lower-case letters and digits, in order, repeats kept; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences line by line: a line is cut at blanks between an end mark and a capital, quote or bracket."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(text, "\n"), bare), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_GAP)))
    return F.filter(F.transform(parts, bare), lambda x: x != "")


def normalised(text: Column) -> Column:
    """Outer white space gone, inner runs single blanks."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def slug(value: Column) -> Column:
    """Lower case, everything but letters and digits one underscore, none at the ends; unknown if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def fact_id(filing: Column, concept: Column, period: Column, dimension: Column, unit: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the five parts; a null dimension is empty."""
    return F.substring(F.sha1(F.concat_ws("|", filing, concept, period, F.coalesce(dimension, F.lit("")), unit)), 1, 16)


def chunk_id(hash_: Column, ordinal: Column) -> Column:
    """Prefix of the content hash and a four-digit ordinal."""
    return F.concat(F.substring(hash_, 1, 16), F.lit("-"), F.when(ordinal < 10000, F.lpad(ordinal.cast("string"), 4, "0")).otherwise(ordinal.cast("string")))


def shortened(text: Column, limit: int) -> Column:
    """At most limit characters of the normalised text, with an ellipsis where it was cut."""
    t = normalised(text)
    return F.when(F.char_length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("…"))).otherwise(t)


def context_prefix(company: Column, kind: Column, period: Column, section: Column) -> Column:
    """The parts that are there, with dots between."""
    return F.concat_ws(" · ", *[F.nullif(c, F.lit("")) for c in (company, kind, period, section)])


def source_title(company: Column, form: Column, period: Column, year: Column, section: Column) -> Column:
    """The parts that are there, with dots between; the year stands in for a missing period."""
    return context_prefix(company, form, F.coalesce(F.nullif(period, F.lit("")), year.cast("string")), section)


def source_url(doc: Column, page: Column) -> Column:
    """The viewer's address of a source, with its page where that is known."""
    return F.concat(F.lit("/sources/"), doc, F.coalesce(F.concat(F.lit("#p"), page.cast("string")), F.lit("")))


def citation_markers(text: Column) -> Column:
    """Numbers of the [n] marks, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))


def figures(text: Column) -> Column:
    """Numbers in a text once its [n] marks are gone; thousands marks stay."""
    bare = F.regexp_replace(text, r"\[\d+\]", " ")
    return F.regexp_extract_all(bare, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1)


def grounding(answer: Column, evidence: Column) -> Column:
    """Share of an answer's figures that stand verbatim in the evidence; 1 if it has none."""
    nums = figures(answer)
    found = F.size(F.filter(nums, lambda n: evidence.contains(n)))
    return F.when(F.size(nums) == 0, F.lit(1.0)).otherwise(found / F.size(nums))


def json_object(text: Column) -> Column:
    """The stretch from the first to the last brace, null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


#: The namespace of point ids: the one for object identifiers of RFC 9562.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def point_id(name: Column, namespace: str = OID_NAMESPACE) -> Column:
    """UUID of version 5 of a name: SHA-1 of namespace and name with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
