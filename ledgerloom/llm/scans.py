"""Repairing text extracted from scanned pages.

Running headers are found by their recurrence at the edges of items over a document's pages, under a
key in which characters that are read for each other are equal, so that a misread copy counts.
Page numbers must follow the pages. Broken words and misread characters are told from the
vocabulary of the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Characters read for each other, and what they become in the key.
SINGLES = ("1l|!\u2020+05896q", "iiiittosbgbg")
WIDER = (("m", "rn"), ("w", "vv"), ("d", "ci"), ("h", "ii"), ("u", "ii"), ("k", "ic"), ("e", "c"))
#: A word is taken for a misreading of another that has the same key and is this many times as frequent.
RATIO = 8
#: How often the other word must occur at least.
KNOWN = 5
#: A header has so many letters at least; items of a document that are ordered in one task.
LETTERS, BLOCK = 3, 256
HYPHENS = "\\-\u2010\u00ad\u00ac"
STOPS = re.compile(r"[.,;:!?\"\u201d\u3002\u0964" + HYPHENS + "]$")
EDGE = r"^[.,;:!?\"'()\[\]{}\u201c\u201d\u2018\u2019\u00ab\u00bb*_<>]+|[.,;:!?\"'()\[\]{}\u201c\u201d\u2018\u2019\u00ab\u00bb*_<>]+$"
BETWEEN_WORDS = r"[\s\u0900-\u0dff\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef\u2022]+"
NUMBER = r"^[$\u20ac\u00a3\u20b9(-]*(?:[A-Z]-)?[0-9OoIilSsBbZzgq|]+(?:[.,][0-9OoIilSsBbZzgq|]+)*[mM]?[%)]*$"

DIGITS = "[0-9lIiOoSsBbZzgq|]{1,9}"
PAGE = "[Pp] ?[ao] ?[gq9] ?[ec]"
#: A printed page number alone; one group for each form, the number in it.
FORMS = tuple(
    re.compile(p)
    for p in (
        rf"\[ ?({DIGITS}) ?\]", rf"\( ?({DIGITS}) ?\)", rf"[-\u2013\u2014] ?({DIGITS}) ?[-\u2013\u2014]", rf"({DIGITS}) ?[|lI] ?{PAGE}",
        rf"{PAGE}:? ({DIGITS})(?: (?:of|0f|oi|/) {DIGITS})?", rf"[A-Z]-({DIGITS})", rf"[Pp]\. ?({DIGITS})", rf"({DIGITS}) ?(?:of|/) ?{DIGITS}", rf"({DIGITS})",
    )
)
STRONG = re.compile(rf"{PAGE}:? {DIGITS} (?:of|0f|oi|/) {DIGITS}")
APART = re.compile(r" \| | {2}")
ROMAN = re.compile(r"(?=.)c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
AS_ROMAN = str.maketrans("1|", "ii")
AS_DIGITS = str.maketrans("lIi|OoSsBbZzgq", "11110055862299")
KEYS = str.maketrans(*SINGLES)


def likeness(c: Column) -> Column:
    """The key of a text in which characters that are read for each other are equal."""
    k = F.translate(F.lower(c), *SINGLES)
    for read, key in WIDER:
        k = F.replace(k, F.lit(read), F.lit(key))
    return k


def from_roman(text: str) -> int:
    """The value of a Roman numeral in lower case."""
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


def page_number(line: str) -> int | None:
    """The number that a line shows if it consists of a printed page number."""
    if len(line) > 40:  # longer than any form
        return None
    if ROMAN.fullmatch(roman := line.strip("[]()- .").translate(AS_ROMAN)):
        return from_roman(roman)
    for form in FORMS:
        if (m := form.fullmatch(line)) and re.search("[0-9]|^[lI|]$", m.group(1)):
            shown = m.group(1).translate(AS_DIGITS)
            return int(shown) if shown.isdigit() else None
    return None


def look(line: str) -> tuple[str, int | None, bool]:
    """(text without page number, page number, whether both stand in one line)."""
    flat = re.sub(r"[ \t\u00a0]+", lambda m: "  " if len(m.group()) > 1 else " ", line).strip()
    n = page_number(flat.replace("  ", " "))
    if n is not None:
        return flat, n, False
    for m in APART.finditer(flat):
        left, right = flat[: m.start()].strip(), flat[m.end() :].strip()
        if re.search(r"[^\W\d_]{2}", left) and (n := page_number(right)) is not None:
            return left, n, True
        if re.search(r"[^\W\d_]{2}", right) and (n := page_number(left)) is not None:
            return right, n, True
    return flat, None, False


def key_of(text: str) -> str:
    """likeness() of a text, with single blanks."""
    k = re.sub(r"\s+", " ", text.lower()).translate(KEYS)
    for read, key in WIDER:
        k = k.replace(read, key)
    return k


BROKEN = re.compile(r"((?:[^\W_]|[|\u2020-])+)([" + HYPHENS + r"])\s*$")
FIRST = re.compile(r"\s*((?:[^\W_]|[|\u2020])+)")
ODD_NUMBER = re.compile(f"(?=.*[0-9])(?=.*[OoIilSsBbZzgq|])(?:{NUMBER})", re.S)
SPLIT, STRIP = re.compile(BETWEEN_WORDS), re.compile(EDGE)


def words_of(text: str) -> list[str]:
    """Words without punctuation at their ends; scripts without blanks part words."""
    return [w for raw in SPLIT.split(text) if (w := STRIP.sub("", raw))]


def paged(df: DataFrame) -> DataFrame:
    return df.where(F.col("page").isNotNull() & F.col("text").isNotNull() & F.col("item_id").isNotNull())


def pages(df: DataFrame) -> DataFrame:
    """One row per item with a page and text, as lines: the rows that come twice are one item."""
    picked = paged(df).groupBy("item_id").agg(F.min(F.struct("source_doc_id", "seq", "role", "page", "text")).alias("r"))
    return picked.select("item_id", F.col("r.source_doc_id").alias("doc"), "r.seq", F.coalesce("r.role", F.lit("text")).alias("role"), F.col("r.page").cast("int").alias("page"), F.split(F.regexp_replace("r.text", r"\r\n?", "\n"), "\n").alias("lines"))


def vocabulary(df: DataFrame) -> DataFrame:
    """(word, n, clean): occurrences in all items, and in items without a page, which are no scans.

    A task adds up the words of its rows before anything is shuffled.
    """

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())  # scans, others

        def rows() -> pd.DataFrame:
            scans, clean = counts
            out = pd.DataFrame([(w, n, 0) for w, n in scans.items()] + [(w, n, n) for w, n in clean.items()], columns=["word", "n", "clean"])
            scans.clear()
            clean.clear()
            return out

        for pdf in batches:
            for text, clean in zip(pdf["text"], pdf["clean"]):
                counts[clean].update(words_of(text.lower()))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield rows()
        yield rows()

    every = df.where(F.col("text").isNotNull()).select("text", F.col("page").isNull().cast("int").alias("clean"))
    return every.mapInPandas(tally, "word string, n bigint, clean bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def misreadings(known: DataFrame) -> DataFrame:
    """(word, meant): words of scans only whose key belongs to a word that is far more frequent.

    Words are joined on their key, never compared pair by pair.
    """
    keyed = known.withColumn("key", likeness(F.col("word")))
    common = keyed.where((F.col("n") >= KNOWN) & F.col("word").rlike(r"\p{L}")).groupBy("key").agg(F.max(F.struct("n", "word")).alias("top"))
    rare = keyed.where((F.col("clean") == 0) & (F.char_length("word") >= 2))
    both = rare.join(common, "key").where((F.col("top.word") != F.col("word")) & (F.col("top.n") >= RATIO * F.col("n")))
    return both.select("word", F.col("top.word").alias("meant"), F.col("n").alias("times"))


def edges_of(lines: list[str]) -> list[tuple]:
    """(at, shown, strong, ends, key) of the lines at an item's edges that may be headers or page numbers.

    The two outermost lines are looked at, and further ones inwards as long as lines end for themselves
    or show a page number.
    """
    n = len(lines)
    out: dict[int, tuple] = {}

    def seen(at: int) -> bool:
        if at not in looked:
            body, shown, joined = look(lines[at])
            follows = at + 1 < n and lines[at + 1][:1].islower()
            # a header ends without punctuation; a line that goes on in lower case is one only if it is known from elsewhere
            able = bool(body) and (joined or shown is None) and len(re.sub(r"[\W\d_]", "", body)) >= LETTERS and not STOPS.search(body)
            ends = joined or at == n - 1 or not follows
            looked[at] = shown is not None or able and ends or not body
            if body and (able or shown is not None):
                out[at] = (at, shown, bool(STRONG.search(lines[at])) or shown is not None and n == 1 and body[:1] in "[(", ends, key_of(body) if able else None)
        return looked[at]

    looked: dict[int, bool] = {}
    for order in (range(n), range(n - 1, -1, -1)):
        for depth, at in enumerate(order):
            if not seen(at) and depth > 0:
                break
    return [out[at] for at in sorted(out)]


def read(df: DataFrame) -> DataFrame:
    """(item_id, doc, seq, page, role, edges, breaks, starts) of each item with a page, once: its edge lines, the
    lines that end in a broken word, and the first word of each of its lines (of the outer ones alone
    where no word is broken)."""

    def look_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for role, text in zip(pdf["role"], pdf["text"]):
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                edges = edges_of(lines) if role not in ("title", "table") else []
                breaks = []
                if role != "table":
                    for at, line in enumerate(lines):
                        if (m := BROKEN.search(line)) and re.search(r"[^\W\d_]", m.group(1)):
                            breaks.append((at, m.group(1), m.group(2)))
                # lines that may go are at the edges: without a broken word only the first ones that may stay matter
                upto = len(lines) if breaks else min(len(lines), max((e[0] for e in edges), default=-1) + 2)
                starts = [m.group(1) if (m := FIRST.match(x)) else None if not x.strip() else "" for x in lines[:upto]]
                rows.append((edges, breaks, starts, len(lines)))
            made = pd.DataFrame(rows, columns=["edges", "breaks", "starts", "size"], index=pdf.index)
            yield pdf[["item_id", "doc", "seq", "page", "role", "mark"]].join(made)

    kind = df.schema["item_id"].dataType.simpleString()
    rows = paged(df).select("item_id", F.col("source_doc_id").alias("doc"), F.col("seq").cast("int").alias("seq"), F.col("page").cast("int").alias("page"), F.coalesce("role", F.lit("text")).alias("role"), F.xxhash64("text").alias("mark"), "text")
    edge = "array<struct<at: int, shown: int, strong: boolean, ends: boolean, key: string>>"
    made = rows.mapInPandas(look_at, f"item_id {kind}, doc string, seq int, page int, role string, mark bigint, edges {edge}, breaks array<struct<at: int, first: string, mark: string>>, starts array<string>, size int")
    cols = ["doc", "seq", "role", "page", "mark", "edges", "breaks", "starts", "size"]
    return made.groupBy("item_id").agg(F.min(F.struct(*cols)).alias("r")).select("item_id", "r.*")


def furniture(edges: DataFrame) -> DataFrame:
    """(item_id, at, header, pageno) of the edge lines that are running headers or page numbers."""
    cand = edges.where(F.col("key").isNotNull())
    # what is said of each different line of a document; copies are many, different lines few
    every = cand.groupBy("doc", "key").agg(F.count_distinct(F.when(F.col("ends"), F.col("page"))).alias("n"), F.count_if(F.col("ends") & (F.col("role") == "text")).alias("texts"), F.max("ends").alias("ends"))
    every = cut_lineage(every.select("doc", "key", ((F.col("n") >= 2) & (F.col("texts") > 0)).alias("running"), "ends"))
    running = every.where("running").select("doc", "key")
    # misreadings that the key does not cover: a few letters away from a header of the document.
    # Three edits leave one of a header's four pieces whole, moved by three places at most, so lines are
    # joined on that piece; they are cut for the lengths of their document's headers alone.
    other = every.where("ends and not running").select("doc", "key")
    size, lengths = F.col("size"), running.select("doc", F.char_length("key").alias("size")).distinct()
    fourth = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part")
    start = lambda part: F.floor(part * size / 4).cast("int")
    long = start(F.col("part") + 1) - start(F.col("part"))
    pieces = running.select("doc", F.col("key").alias("header_key"), F.char_length("key").alias("size"), fourth)
    pieces = pieces.withColumn("piece", F.col("header_key").substr(start(F.col("part")) + 1, long))
    cut = other.join(lengths, "doc").where(F.abs(F.char_length("key") - size) <= 3).select("doc", "key", "size", fourth)
    cut = cut.withColumn("from", F.explode(F.sequence(start(F.col("part")) - 2, start(F.col("part")) + 4))).where("from >= 1")
    cut = cut.select("doc", "key", "size", "part", F.col("key").substr(F.col("from"), long).alias("piece")).distinct()
    near = cut.join(pieces, ["doc", "size", "part", "piece"]).where(F.levenshtein("key", "header_key", 3) >= 0)
    # a near line counts where it ends for itself
    names = running.withColumn("near", F.lit(False)).unionByName(near.select("doc", "key").distinct().withColumn("near", F.lit(True)))
    header = cand.join(names, ["doc", "key"]).where(~F.col("near") | F.col("ends")).select("item_id", "at", F.lit("header").alias("kind"))

    numbers = edges.where(F.col("shown").isNotNull()).withColumn("shift", F.col("shown") - F.col("page"))
    steady = numbers.groupBy("doc", "shift").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= 2).select("doc", "shift", F.lit(True).alias("steady"))
    pageno = numbers.join(steady, ["doc", "shift"], "left").where(F.col("strong") | F.col("steady")).select("item_id", "at", F.lit("pageno").alias("kind"))
    both = header.unionByName(pageno).groupBy("item_id", "at")
    return both.agg((F.count_if(F.col("kind") == "header") > 0).alias("header"), (F.count_if(F.col("kind") == "pageno") > 0).alias("pageno"))


def content(items: DataFrame, found: DataFrame) -> DataFrame:
    """The items with their lines but for headers and page numbers."""
    gone = found.groupBy("item_id").agg(F.collect_set("at").alias("gone"))  # lines at one item's edges
    kept = F.filter("lines", lambda line, k: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), k))
    return items.join(gone, "item_id", "left").withColumn("lines", F.filter(kept, lambda x: F.trim(x) != "")).drop("gone")


def broken_words(seen: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, at, first, mark, second, second_id) of lines that end in a hyphen after letters; at counts
    the lines without headers and page numbers. The second half begins the next line, or the next item
    of the document that holds text, however far on it stands.

    The next item is sought within blocks of items, and over the first items of the blocks alone where a
    block has none, so that a document with a third of all items is spread over its blocks.
    """
    pair = f"struct<second: string, second_id: {seen.schema['item_id'].dataType.simpleString()}>"
    gone = found.groupBy("item_id").agg(F.collect_set("at").alias("gone"))  # lines at one item's edges
    rows = seen.join(gone, "item_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # lines that stay: place and first word; blank ones go as well
    kept = F.filter(F.transform("starts", lambda w, k: F.struct(k.alias("at"), w.alias("w"))), lambda x: x["w"].isNotNull() & ~F.array_contains("gone", x["at"]))
    rows = rows.withColumn("kept", kept)
    lines = rows.where(F.size("breaks") > 0).select("item_id", "doc", "seq", "kept", F.explode("breaks").alias("b")).where(F.expr("exists(kept, x -> x.at = b.at)"))
    after = F.filter("kept", lambda x: x["at"] > F.col("b.at"))
    lines = lines.select("item_id", "doc", "seq", (F.size("kept") - F.size(after) - 1).alias("at"), "b.first", "b.mark", F.get(after, F.lit(0))["w"].alias("second"), (F.size(after) == 0).alias("open"))
    inside = lines.where(~F.col("open")).select("item_id", "at", "first", "mark", "second", F.col("item_id").alias("second_id"))
    ends = lines.where("open").select("doc", "seq", "item_id", F.struct("at", "first", "mark").alias("end"), F.lit(None).cast(pair).alias("start"))
    begins = rows.where((F.col("role") == "text") & (F.size("kept") > 0))
    start = F.struct(F.get("kept", F.lit(0))["w"].alias("second"), F.col("item_id").alias("second_id"))
    begins = begins.select("doc", "seq", "item_id", F.lit(None).cast("struct<at: int, first: string, mark: string>").alias("end"), start.alias("start"))
    both = ends.unionByName(begins).withColumn("block", F.floor(F.col("seq") / BLOCK))
    back = Window.partitionBy("doc", "block").orderBy(F.desc("seq"), F.desc("item_id")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("next", F.last("start", ignorenulls=True).over(back)).where("end is not null")
    heads = both.where("start is not null").groupBy("doc", "block").agg(F.min_by("start", F.struct("seq", "item_id")).alias("head"))
    blocks = heads.unionByName(near.where("next is null").select("doc", "block", F.lit(None).cast(pair).alias("head")).distinct())
    blocks = blocks.groupBy("doc", "block").agg(F.max("head").alias("head"))
    chain = Window.partitionBy("doc").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    far = blocks.select("doc", "block", F.last("head", ignorenulls=True).over(chain).alias("far"))
    across = near.join(far, ["doc", "block"], "left").withColumn("s", F.coalesce("next", "far"))
    return inside.unionByName(across.select("item_id", "end.at", "end.first", "end.mark", "s.second", "s.second_id"))


def judge_breaks(breaks: DataFrame, known: DataFrame) -> DataFrame:
    """Adds joined, with_hyphen (how often each spelling occurs) and broken."""
    j = F.lower(F.concat("first", F.coalesce("second", F.lit(""))))
    h = F.lower(F.concat_ws("-", "first", "second"))
    rows = breaks.withColumns({"joined": j, "compound": h, "key": likeness(j)})
    v = known.select("word", "n", "clean")
    rows = rows.join(v.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
    rows = rows.join(v.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
    alike = v.where((F.col("n") >= KNOWN) & F.col("word").rlike(r"\p{L}")).groupBy(likeness(F.col("word")).alias("key")).agg(F.max(F.struct("n", "word")).alias("top"))
    rows = rows.join(alike, "key", "left")
    soft = F.col("mark").isin("\u00ad", "\u00ac", "\u2010")
    lower = F.coalesce(F.col("second").rlike(r"^\p{Ll}"), F.lit(False))
    better = F.coalesce("n_joined", F.lit(0)) + F.coalesce("top.n", F.lit(0)) > F.coalesce("n_compound", F.lit(0))
    broken = soft | (better & (F.col("top").isNotNull() | F.col("n_joined").isNotNull())) | F.col("n_compound").isNull() & (lower | F.col("second").isNull())
    meant = F.col("top.word")
    return rows.withColumns({"broken": broken, "meant": F.when((F.col("top.n") >= RATIO * F.coalesce("n_joined", F.lit(1))) & (meant != F.col("joined")), meant)})


def parts(df: DataFrame) -> dict[str, DataFrame]:
    # written to the shared folder: what follows then has short plans, which keeps the driver small
    seen = cut_lineage(read(df))
    edges = seen.select("item_id", "doc", "page", "role", F.explode("edges").alias("e")).select("item_id", "doc", "page", "role", "e.*")
    found = cut_lineage(furniture(edges))
    known = cut_lineage(vocabulary(df))
    return {"furniture": found, "vocabulary": known, "breaks": cut_lineage(judge_breaks(broken_words(seen, found), known)), "misread": cut_lineage(misreadings(known))}


def tokens(df: DataFrame) -> DataFrame:
    """(item_id, word, number): the different words of each row with a page, and whether one is a number with
    letters in the place of digits."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [set(words_of(t)) for t in pdf["text"]]
            flat = [w for ws in words for w in ws]
            number = [bool(ODD_NUMBER.match(w)) for w in flat]
            yield pd.DataFrame({"item_id": pdf["item_id"].repeat([len(w) for w in words]).to_numpy(), "word": [w.lower() for w in flat], "number": number})

    kind = df.schema["item_id"].dataType.simpleString()
    return paged(df).select("item_id", "text").mapInPandas(cut, f"item_id {kind}, word string, number boolean")


def noise(df: DataFrame) -> DataFrame:
    """(item_id, kind) of the items with a page: hyphen, char, header, pageno, each once.

    Rows without page, text or item_id are left out; blank texts, empty tables and extra columns do
    no harm; lines, words and headers of any length count whole.
    """
    p = parts(df)
    header = p["furniture"].where("header").select("item_id", F.lit("header").alias("kind"))
    pageno = p["furniture"].where("pageno").select("item_id", F.lit("pageno").alias("kind"))
    broken = p["breaks"].where("broken")
    hyphen = broken.select("item_id", F.lit("hyphen").alias("kind"))
    known = p["vocabulary"].where((F.col("clean") > 0) & F.col("word").rlike("[0-9]")).select("word", F.lit(True).alias("clean"))
    misread = tokens(df).join(p["misread"].select("word", F.lit(True).alias("misread")), "word", "left").where(F.col("number") | F.col("misread"))
    misread = misread.join(known, "word", "left").where(F.col("misread") | F.col("clean").isNull())
    halves = broken.where(F.col("meant").isNotNull())
    first = halves.where(F.substring("meant", 1, 1).isNotNull() & ~F.col("meant").startswith(F.lower("first"))).select("item_id")
    second = halves.where(~F.col("meant").endswith(F.lower("second"))).select(F.col("second_id").alias("item_id"))
    char = misread.select("item_id").unionByName(first).unionByName(second).where(F.col("item_id").isNotNull())
    return header.unionByName(pageno).unionByName(hyphen).unionByName(char.select("item_id", F.lit("char").alias("kind"))).distinct()


def mended(lines: list[str], breaks: dict[int, tuple[str, str]], skip: str, meant: dict[str, str]) -> str:
    """One paragraph of an item's lines: halves joined, misread words replaced, blanks single.

    breaks: by line, the two halves of a word broken at its end; skip: the half at the start of the
    item that went to the item before.
    """
    out: list[str] = []
    for at, line in enumerate(lines):
        line = line.strip()
        if at == 0 and skip and line.startswith(skip):
            line = line[len(skip) :].lstrip()
        if at - 1 in breaks and at > 0:
            line = line[len(breaks[at - 1][1]) :]
            out[-1] += line
        else:
            out.append(line)
        if at in breaks:
            first, second = breaks[at]
            out[-1] = re.sub("[" + HYPHENS + r"]\s*$", "", out[-1]) + second
    text = re.sub(r"\s+", " ", " ".join(x for x in out if x)).strip()

    def fix(m: re.Match) -> str:
        word = m.group()
        new = meant.get(word.lower())
        if new is None:
            return word
        if word.isupper() and len(word) > 2:
            return new.upper()
        return new[:1].upper() + new[1:] if word[:1].isupper() or word[:1].isdigit() and word[:1] != new[:1] and text[: m.start()].rstrip()[-1:] in ("", ".") else new

    return re.sub(r"[^\s.,;:!?\"'()\[\]]+", fix, text) if meant else text


def repair(df: DataFrame) -> DataFrame:
    """(item_id, doc, page, seq, role, text): the items with a page as paragraphs, repaired.

    Tables keep their lines. Items that hold only headers and page numbers go. A word broken over two
    items stays whole in the first. A misread number keeps its reading as digits.
    """
    p = parts(df)
    items = pages(df)
    body = content(items, p["furniture"])
    broken = p["breaks"].where("broken and second is not null and second <> ''")
    own = broken.groupBy("item_id").agg(F.collect_list(F.struct("at", "first", "second")).alias("own"))
    taken = broken.where("second_id <> item_id").groupBy(F.col("second_id").alias("item_id")).agg(F.max("second").alias("skip"))
    token = tokens(df).select("item_id", "word").distinct()
    fixes = token.join(p["misread"], "word").select("item_id", "word", "meant")
    joined = broken.where("meant is not null").select("item_id", F.col("joined").alias("word"), "meant")
    fixes = fixes.unionByName(joined).groupBy("item_id").agg(F.collect_set(F.struct("word", "meant")).alias("fixes"))
    rows = body.where(F.size("lines") > 0).join(own, "item_id", "left").join(taken, "item_id", "left").join(fixes, "item_id", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for role, lines, own, skip, fixes in zip(pdf["role"], pdf["lines"], pdf["own"], pdf["skip"], pdf["fixes"]):
                meant = {f["word"]: f["meant"] for f in fixes} if fixes is not None else {}
                breaks = {b["at"]: (b["first"], b["second"]) for b in own} if own is not None and role != "table" else {}
                if role == "table":
                    texts.append("\n".join(mended([x], {}, "", meant) for x in lines))
                else:
                    texts.append(mended(list(lines), breaks, skip or "", meant))
            yield pdf[["item_id", "doc", "page", "seq", "role"]].assign(text=texts)

    kind = items.schema["item_id"].dataType.simpleString()
    cols = rows.select("item_id", "doc", "page", F.col("seq").cast("int").alias("seq"), "role", "lines", "own", "skip", "fixes")
    return cols.mapInPandas(write, f"item_id {kind}, doc string, page int, seq int, role string, text string")
