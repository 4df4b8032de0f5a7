"""Splitting oversized items at natural boundaries by lexical cohesion."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2048, 256
#: Sentences on each side of a gap that are compared.
BLOCK = 4

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?:[.!?]+[\"'”’)\]]*\s+|[。！？।]+[\"”’」』）]*\s*|\s*\n\s*)")
LINE_END = re.compile(r"\s*\n\s*")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
SPACE = re.compile(r"\s+")


def gaps(text: str, role: str | None) -> list[int]:
    """Offsets of the ends of sentences, or of lines in tables."""
    pattern = LINE_END if role == "table" else SENTENCE_END
    return [m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text)]


def valleys(text: str, cuts: list[int], block: int = BLOCK) -> list[float]:
    """Depth of the similarity valley at each gap: how far the cosine of the word counts of the
    two neighbouring blocks lies below the peaks on its left and right."""
    edges = [0, *cuts, len(text)]
    bags = [Counter(w.lower() for w in WORD.findall(text, a, b)) for a, b in zip(edges, edges[1:])]
    n, similar = len(cuts), []
    left, right = Counter(), Counter()
    for bag in bags[1 : 1 + block]:
        right.update(bag)
    left.update(bags[0])
    for k in range(n):
        small, large = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(c * large[w] for w, c in small.items() if w in large)
        norm = sqrt(sum(c * c for c in left.values()) * sum(c * c for c in right.values()))
        similar.append(dot / norm if norm else 0.0)
        left.update(bags[k + 1])
        if k + 1 - block >= 0:
            left.subtract(bags[k + 1 - block])
            left = +left
        right.subtract(bags[k + 1])
        right = +right
        if k + 1 + block < len(bags):
            right.update(bags[k + 1 + block])
    up_left, up_right = similar[:], similar[:]
    for k in range(1, n):
        if similar[k - 1] >= similar[k]:
            up_left[k] = up_left[k - 1]
    for k in range(n - 2, -1, -1):
        if similar[k + 1] >= similar[k]:
            up_right[k] = up_right[k + 1]
    return [up_left[k] + up_right[k] - 2 * similar[k] for k in range(n)]


def pieces(text: str, role: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, fresh, end): text[start:fresh] repeats the end of the piece before.

    Within the last half of each size window the deepest valley is taken, a paragraph's end
    counting for one more; without any sentence end the last white space, else a hard cut.
    """
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    cuts = gaps(text, role)
    depth = valleys(text, cuts) if cuts else []
    paragraph = {m.end() for m in PARAGRAPH.finditer(text)}
    out, start, fresh, at = [], 0, 0, 0
    while n - start > limit:
        low, high = max(fresh + 1, start + limit // 2), start + limit
        while at < len(cuts) and cuts[at] <= fresh:
            at += 1
        best, k = None, at
        while k < len(cuts) and cuts[k] <= high:
            if cuts[k] >= low:
                score = (depth[k] + (cuts[k] in paragraph), cuts[k])
                best = max(best, score) if best else score
            k += 1
        if best:
            end = best[1]
        elif k > at:
            end = cuts[k - 1]
        else:
            blank = max((m.end() for m in SPACE.finditer(text, low, high)), default=0)
            end = blank if blank > fresh else high
        out.append((start, fresh, end))
        back = max(start + 1, end - overlap)
        inner = [c for c in cuts[at:k] if back <= c < end]
        word = SPACE.search(text, back, end)
        start, fresh = (inner[0] if inner else word.end() if word and word.end() < end else back), end
    out.append((start, fresh, n))
    return out


def split_oversized(
    df: DataFrame, key: str = "item_id", text: str = "text", role: str = "role", level: str = "level", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces (key, role, level, piece, pieces, start, fresh, text) of every item over the limit.

    Sizes are code points of the text without outer white space, to which the offsets refer too.
    Items up to the limit, blank, empty and null texts give no row. Items that come twice are cut
    once per different row. Each piece but the first begins with up to `overlap` characters of
    the one before; piece counts from 1. Other columns are left out.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and under half of the limit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, raw, r, lev in zip(pdf["key"], pdf["text"], pdf["role"], pdf["level"]):
                body = raw.strip()
                if len(body) > limit:
                    parts = pieces(body, r, limit, overlap)
                    rows += [(k, r, lev, i, len(parts), a, f, body[a:b]) for i, (a, f, b) in enumerate(parts, 1)]
            out = pd.DataFrame(rows, columns=["key", "role", "level", "piece", "pieces", "start", "fresh", "text"])
            yield out.astype({"level": "Int32"})

    kind = df.schema[key].dataType.simpleString()
    large = (
        df.where(F.char_length(F.col(text)) > limit)
        .select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(role).alias("role"), F.col(level).cast("int").alias("level"))
        .distinct()
    )
    out = large.mapInPandas(cut, f"key {kind}, role string, level int, piece int, pieces int, start int, fresh int, text string")
    return out.withColumnRenamed("key", key)
