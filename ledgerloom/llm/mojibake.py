"""Finding and restoring text that was decoded with the wrong encoding.

Each stretch of characters beyond ASCII is the start of a best-first search. A step encodes
the stretch with one of the encodings and decodes it again (as UTF-8, or as Windows-1252 when
single bytes were confused), undoes a change of letter case, or resolves character references.
States are kept by hash, so none is opened twice. What guides the search is a plausibility cost
of the characters in their context; the cheapest text reached that used a decoding step wins
if it is clearly cheaper than the stretch was.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings that are taken for UTF-8, and those that are taken for Windows-1252.
FOR_UTF8 = ("cp1252", "cp1250", "mac_roman", "cp437", "cp1251", "cp850", "iso8859_2", "iso8859_15", "cp1254", "cp1257")
FOR_1252 = ("cp1251", "cp850", "cp437", "mac_roman", "cp1250")
#: States opened at most for one stretch; a stretch has fewer unless it was garbled several times.
OPENED = 80
STEP, GAIN = 0.25, 0.7

# scripts that no encoding with single bytes shares with others are left out
RUN = re.compile("(?:[^\x00-\x7f\u0900-\u0dff\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff5e]|&#?\\w{2,8};)+")
UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")

#: What a line in such an encoding shows again and again: lead bytes of kana.
WIDE_MARK = re.compile(r"(?:‚[^\s].?){3}|(?:ƒ[^\s].?){3}|(?:¤[^\s]){3}|(?:[°-¿À-ß][°-¿À-ß¡-¯]){6}")

CURRENCY, OPENING, CLOSING = "€£₹¥$¢", "“‘„‚«‹¿¡", "”’»›…"
PLAIN = "\u2013\u2014\u2010\u2011\u2022\u2020\u2021\u2116\u2032\u2033\u00b7\u00b0\u00a7\u00b1\u00ae\u00a9\u2122\u00b2\u00b3\u00bd\u00bc\u00be\u00d7\u00f7\u00a0\u00ad\u200b\u200c\u200d\u200e\u200f\ufeff\u2009\u202f\u2003\u2002\u3000\u2028\u0085"
LOOSE = "\u2013\u2014\u00a0\u00ad\u200b\u200c\u200d\u00b0\u00b2\u00b3\u2122\u00ae\u2009\u202f\u2003\u2002\ufeff\u2028"


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves open stand for themselves."""
    out = {}
    for b in range(128, 256):
        out.setdefault(chr(b), b) if encoding == "cp1252" else None
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


TO_BYTE = {e: _bytes_of(e) for e in {*FOR_UTF8, *FOR_1252}}
OF_BYTE = {b: c for c, b in TO_BYTE["cp1252"].items() if not "\x80" <= c <= "\x9f"}
AS_1252 = {e: {c: OF_BYTE.get(b, chr(b)) for c, b in TO_BYTE[e].items()} for e in FOR_1252}
#: Encodings of whole lines in which a character has bytes below 128 too.
WIDE = ("cp932", "euc_jp", "gb18030", "cp949")


@lru_cache(65536)
def kind(c: str) -> tuple[str, str]:
    """(general category, script or class)."""
    cat, o = unicodedata.category(c), ord(c)
    if o < 128:
        return cat, "latin" if c.isalpha() else "ascii"
    if cat[0] in "LM":
        for low, high, name in (
            (0xC0, 0x17F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x218, 0x21B, "latin"), (0x386, 0x3CE, "greek"), (0x400, 0x45F, "cyrillic"), (0x490, 0x4FF, "cyrillic"),
            (0x5D0, 0x5EA, "hebrew"), (0x600, 0x6FF, "arabic"), (0x900, 0x97F, "nagari"), (0x980, 0xDFF, "indic"), (0xE00, 0xE7F, "thai"), (0x300, 0x36F, "mark"),
            (0x3005, 0x30FF, "cjk"), (0x4E00, 0x9FFF, "cjk"), (0xAC00, 0xD7A3, "hangul"), (0xFF66, 0xFF9F, "halfkana"), (0xAA, 0xAA, "ordinal"), (0xBA, 0xBA, "ordinal"),
        ):
            if low <= o <= high:
                return cat, name
        return cat, "rare"
    return cat, "other"


@lru_cache(262144)
def char_cost(before: str, c: str, after: str) -> float:
    """How implausible a character beyond ASCII is between its neighbours ("" at an edge)."""
    cat, script = kind(c)
    b_cat, b_script = kind(before) if before else ("", "")
    a_cat, a_script = kind(after) if after else ("", "")
    if c == "�":
        return 8.0
    if cat in ("Cc", "Cn", "Co", "Cs"):
        return 6.0
    if script == "rare":
        return 4.0
    if script == "halfkana":
        return 2.0
    if script == "ordinal":
        return 1.0 if b_cat == "Nd" or before == "." else 3.0
    if script == "mark":
        return 2.5 if b_cat[:1] == "L" else 4.0
    if script == "latin":
        cost = 1.0 + (0.4 if c in "ÐðÞþÆæ" else 0.0) + (0.6 if ord(c) > 0x17F and ord(c) < 0x1E00 else 0.0)
        if cat == "Lu" and b_cat == "Ll":
            cost += 4.0
        elif cat == "Lu" and a_cat == "Ll" and b_cat == "Lu":
            cost += 1.0
        elif cat == "Ll" and b_cat == "Lu" and a_cat == "Lu":
            cost += 1.0
        if a_cat == "Nd" and b_cat[:1] != "L":
            cost += 2.0
        if a_script in ("nagari", "greek", "cyrillic", "cjk") or b_script in ("nagari", "greek", "cyrillic"):
            cost += 3.0
        return cost
    if script in ("greek", "cyrillic", "nagari", "indic", "thai", "hebrew", "arabic", "hangul"):
        mixed = "latin" in (b_script, a_script) or a_cat == "Nd" and script in ("greek", "cyrillic")
        late = 2.0 if cat == "Lu" and b_cat == "Ll" else 0.0
        return 1.0 + late + (4.0 if mixed else 0.0)
    if script == "cjk":
        return 1.0
    letter_before = b_cat[:1] == "L" and b_script not in ("cjk", "halfkana")
    if c in CURRENCY:
        return 1.0 + (4.0 if letter_before else 0.0) + (2.0 if a_cat[:1] == "L" and a_script != "cjk" else 0.0)
    if c in OPENING:
        return 1.0 + (4.0 if letter_before or b_cat == "Sc" else 0.0)
    if c in CLOSING:
        joined = a_cat[:1] == "L" and c != "’" or a_cat == "Sc"
        return (0.3 if letter_before or b_cat[:1] in "NP" and before else 1.5) + (2.5 if joined else 0.0)
    if c in PLAIN:
        return 1.0 + (2.0 if letter_before and ord(before) > 127 and c not in LOOSE else 0.0)
    if cat == "So" and ord(c) >= 0x2600 or ord(c) >= 0x1F000 or cat == "Mn":
        return 1.0
    if 0x3000 <= ord(c) <= 0x303F or 0xFF00 <= ord(c) <= 0xFF65:
        return 1.0
    if cat[:1] == "P":
        return 1.5
    near = (2.0 if letter_before else 0.0) + (2.0 if a_cat[:1] == "L" and a_script != "cjk" else 0.0)
    return 2.5 + near


def cost(before: str, text: str, after: str) -> float:
    """Sum over the characters of a stretch; ASCII costs nothing."""
    total, last = 0.0, len(text) - 1
    for k, c in enumerate(text):
        if c > "\x7f":
            total += char_cost(text[k - 1] if k else before, c, text[k + 1] if k < last else after)
    return total


def redecode(text: str, encoding: str) -> str:
    """Every run of characters whose bytes in the encoding are valid UTF-8 becomes that text."""
    table = TO_BYTE[encoding]
    raw = bytes(table.get(c, 0x20) if c > "\x7f" else 0x20 for c in text)
    out, at = [], 0
    for m in UTF8.finditer(raw):
        out += (text[at : m.start()], m.group().decode("utf-8"))
        at = m.end()
    return "".join(out) + text[at:] if at else text


def recase(text: str, lower: bool) -> str:
    """Other letter case, character by character; characters without a single counterpart stay."""
    other = [c.lower() if lower else "\u0178" if c == "ÿ" else c.upper() for c in text]
    return "".join(n if len(n) == 1 else c for n, c in zip(other, text))


def steps(text: str, first: bool) -> Iterator[tuple[str, bool, bool]]:
    """(next text, whether a decoding was undone, whether to go on from it)."""
    for e in FOR_UTF8:
        yield redecode(text, e), True, True
    if first:
        for e in FOR_1252:
            table = AS_1252[e]
            yield "".join(table.get(c, c) if c > "\x7f" else c for c in text), True, False
    if "&" in text:
        yield html.unescape(text), False, True
    yield recase(text, True), False, True
    yield recase(text, False), False, True


@lru_cache(200_000)
def cheapest(before: str, run: str, after: str) -> tuple[str, bool, bool]:
    """(cheapest text, whether the stretch was decoded wrongly, whether states were left unopened)."""
    first = cost(before, run, after)
    best, goal, queue, seen, opened = first - GAIN, run, [(first, 0, run)], {run}, 0
    while queue and opened < OPENED:
        _, depth, text = heapq.heappop(queue)
        opened += 1
        for new, decoded, go_on in steps(text, depth == 0):
            if new == text or decoded and new == run:
                continue
            c = cost(before, new, after) + STEP * (depth + 1)
            if decoded and c < best:
                best, goal = c, new
            if go_on and new not in seen and depth < 5 and c <= first + 12:
                seen.add(new)
                heapq.heappush(queue, (c, depth + 1, new))
    return goal, goal != run or "�" in run or any("\x80" <= c <= "\x9f" and c != "\x85" for c in run), bool(queue)


def wide_line(line: str) -> str | None:
    """The line with its bytes read as a multi-byte East Asian encoding, if that is much more plausible."""
    table = TO_BYTE["cp1252"]
    try:
        raw = bytes(table[c] if c > "\x7f" else ord(c) for c in line)
    except KeyError:
        return None
    was = cost("", line, "")
    for e in WIDE:
        try:
            new = raw.decode(e)
        except UnicodeDecodeError:
            continue
        if sum(kind(c)[1] in ("cjk", "hangul") for c in new) >= 4 and cost("", new, "") < 0.5 * was:
            return new
    return None


@lru_cache(200_000)
def suspicious(before: str, run: str, after: str) -> bool:
    """Whether a stretch can be garbled at all: some character is implausible where it stands, or
    two characters follow each other that are bytes of one UTF-8 character in some encoding."""
    last = len(run) - 1
    for k, c in enumerate(run):
        if char_cost(run[k - 1] if k else before, c, run[k + 1] if k < last else after) > 1.9:
            return True
    return "&" in run and html.unescape(run) != run or any(UTF8.search(bytes(TO_BYTE[e].get(c, 0x20) for c in run)) for e in FOR_UTF8[:6])


def restore(text: str) -> tuple[str, int, int]:
    """(restored text, garbled stretches, stretches that stay garbled)."""
    if text.isascii() and "&" not in text:
        return text, 0, 0
    bad, stuck, lines = 0, 0, text.split("\n")
    for n, line in enumerate(lines):
        if line.isascii() and "&" not in line:
            continue
        if WIDE_MARK.search(line) and (new := wide_line(line)):
            lines[n] = new
            bad += 1
            continue
        out, at = [], 0
        for m in RUN.finditer(line):
            run, a, b = m.group(), m.start(), m.end()
            if run.isascii() and html.unescape(run).isascii():
                continue
            before, after = line[a - 1 : a] if a else "", line[b : b + 1]
            if not suspicious(before, run, after):
                continue
            new, wrong, cut = cheapest(before, run, after)
            if wrong:
                bad += 1
                stuck += cut or new == run
                out += (line[at:a], new)
                at = b
        if at:
            lines[n] = "".join(out) + line[at:]
    return "\n".join(lines), bad, stuck


def restore_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stretches, unrestored, restored) of every row with a garbled stretch.

    Null, empty and clean texts give no row; a repeated row gives one each time. What cannot be
    restored (replacement characters, say) stays as it is and is counted as unrestored, and so is a stretch
    whose search stopped at OPENED states, with the best text found so far. Only the
    two columns are read; rows stay where they are.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *restore(t)) for k, t in zip(pdf["key"], pdf["text"])]
            rows = [(k, bad, stuck, t) for k, t, bad, stuck in rows if bad]
            yield pd.DataFrame(rows, columns=["key", "stretches", "unrestored", "restored"])

    type_name = df.schema[key].dataType.simpleString()
    # only a text beyond ASCII, or with a character reference, can hold a garbled stretch
    some = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where((F.octet_length("text") > F.char_length("text")) | F.col("text").contains("&"))
    return some.mapInPandas(search, f"key {type_name}, stretches int, unrestored int, restored string").withColumnRenamed("key", key)
