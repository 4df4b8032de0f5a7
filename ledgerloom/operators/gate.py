"""The measures of the chunking gate, taken within the row of a text, so that of the texts nothing moves."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import OPENING, split_text

#: Places of a bag of words.
WIDTH = 64
#: Characters of texts that are measured together; a longer text is measured alone. It changes no result.
TOGETHER = 1_000_000
#: Characters to be searched from which a text's blocks are looked up by their opening words.
SEARCHED = 20_000_000
#: White space, words and gaps as in functions.text, where Spark's expressions know ASCII alone.
BLANK = " \t\n\x0b\f\r"
BLANKS = re.compile(r"[ \t\n\x0b\f\r]{2,}|[\t\n\x0b\f\r]")
WORD = re.compile("[a-z0-9]+")
GAP = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z\"'(])")


def bare(text: str) -> str:
    """Outer white space gone, also before a line end that is none to \\s, where $ holds as well."""
    text = text.lstrip(BLANK)
    return text[:-1].rstrip(BLANK) + text[-1] if text.endswith(("\x85", "\u2028", "\u2029")) else text.rstrip(BLANK)


def sentences(text: str) -> list[str]:
    """As functions.text.sentences."""
    out = []
    for line in text.split("\n"):
        if line := bare(line):
            out.extend(s for part in GAP.split(line) if (s := bare(part)))
    return out


def normalised(text: str) -> str:
    """As functions.text.normalised."""
    return BLANKS.sub(" ", bare(text))


def xxhash64(data: bytes, seed: int = 42) -> int:
    """As Spark's function, without a sign."""
    p1, p2, p3, p4, p5, top = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261, 2**64 - 1
    turned = lambda x, n: (x << n | x >> 64 - n) & top
    mixed = lambda h, x: turned((h + x * p2) & top, 31) * p1 & top
    at, h = 0, seed + p5
    if len(data) >= 32:
        lanes = [(seed + p1 + p2) & top, (seed + p2) & top, seed, (seed - p1) & top]
        while at + 32 <= len(data):
            lanes = [mixed(v, int.from_bytes(data[at + 8 * n : at + 8 * n + 8], "little")) for n, v in enumerate(lanes)]
            at += 32
        h = sum(turned(v, n) for v, n in zip(lanes, (1, 7, 12, 18))) & top
        for v in lanes:
            h = ((h ^ mixed(0, v)) * p1 + p4) & top
    h = (h + len(data)) & top
    while at + 8 <= len(data):
        h = (turned(h ^ mixed(0, int.from_bytes(data[at : at + 8], "little")), 27) * p1 + p4) & top
        at += 8
    if at + 4 <= len(data):
        h = (turned(h ^ int.from_bytes(data[at : at + 4], "little") * p1 & top, 23) * p2 + p3) & top
        at += 4
    for x in data[at:]:
        h = turned(h ^ x * p5 & top, 11) * p1 & top
    h = (h ^ h >> 33) * p2 & top
    h = (h ^ h >> 29) * p3 & top
    return h ^ h >> 32


class Places(dict):
    """The place of each word in a bag, kept for as many words as fit."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        place = self[word] = xxhash64(word.encode()) % WIDTH
        return place


class Bags:
    """Sentences by number, each once, with their bags of words."""

    def __init__(self, places: Places):
        self.places, self.numbers, self.rows = places, {}, np.zeros((0, WIDTH), np.int32)

    def number(self, sentence: str) -> int:
        return self.numbers.setdefault(sentence, len(self.numbers))

    def of(self, numbers: list[int]) -> np.ndarray:
        new = list(self.numbers)[len(self.rows) :]
        if new:
            words = [WORD.findall(s.lower()) for s in new]
            place = np.array([self.places[w] for ws in words for w in ws], np.int64)
            row = np.repeat(np.arange(len(new)), [len(ws) for ws in words])
            made = np.bincount(row * WIDTH + place, minlength=len(new) * WIDTH).astype(np.int32)
            self.rows = np.concatenate([self.rows, made.reshape(-1, WIDTH)])
        return self.rows[np.array(numbers, np.int64)]


def added(rows: np.ndarray) -> np.ndarray:
    """Running sums, with zeros before the first."""
    return np.concatenate([np.zeros((1, *rows.shape[1:]), np.float64), np.cumsum(rows, axis=0, dtype=np.float64)])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b, dtype=np.float64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 where either norm is 0; the counts are whole numbers, so the dots are exact in any order."""
    norm = np.sqrt(dots(a, a) * dots(b, b))
    return np.where(norm == 0, 0.0, dots(a, b) / np.where(norm == 0, 1, norm))


def percentile(values: list[float], p: float) -> float:
    """As Spark's percentile, operation by operation, as cuts lie strictly above it."""
    values, at = sorted(values), (len(values) - 1) * p
    low, high = int(np.floor(at)), int(np.ceil(at))
    if low == high or values[low] == values[high]:
        return values[low]
    return (high - at) * values[low] + (at - low) * values[high]


def segments(texts: list[list[str]], bags: Bags, buffer: int, share: float) -> list[list[str]]:
    """The texts, given as sentences, cut as by chunking.semantic_cuts: the joined sentences of each segment."""
    stop = np.cumsum([len(s) for s in texts])
    total = added(bags.of([bags.number(s) for own in texts for s in own]))
    lo, hi = np.repeat(stop - [len(s) for s in texts], [len(s) for s in texts]), np.repeat(stop, [len(s) for s in texts])
    here = np.arange(len(lo))
    around = total[np.minimum(here + buffer + 1, hi)] - total[np.maximum(here - buffer, lo)]
    d = 1.0 - cosines(around[:-1], around[1:])
    out, start = [], 0
    for own in texts:
        far = d[start : start + len(own) - 1].tolist() if own else []
        start += len(own)
        if not own:
            out.append([])
            continue
        slope = [0.0] * len(far)
        if len(far) > 1:
            slope = [far[1] - far[0], *((far[n + 1] - far[n - 1]) / 2 for n in range(1, len(far) - 1)), far[-1] - far[-2]]
        limit = percentile(slope, share) if slope else 0.0
        cuts = [0, *(n + 1 for n, x in enumerate(slope) if x > limit), len(own)]
        out.append([" ".join(own[a:b]) for a, b in zip(cuts, cuts[1:])])
    return out


def standing(blocks: set[str], chunks: list[str]) -> set[str]:
    """Blocks that stand whole, as runs of words, in a chunk; all are normalised."""
    if len(blocks) * sum(map(len, chunks)) <= SEARCHED:
        text = "\n".join(f" {c} " for c in chunks)
        return {b for b in blocks if f" {b} " in text}
    opening: dict[str, list[str]] = {}
    for b in blocks:
        opening.setdefault(" ".join(b.split(" ", OPENING)[:OPENING]), []).append(b)
    lengths, found = {o.count(" ") + 1 for o in opening}, set()
    for c in chunks:
        words, text = c.split(" "), f" {c} "
        runs = {" ".join(words[n : n + k]) for k in lengths for n in range(len(words) - k + 1)}
        found.update(b for run in runs & opening.keys() for b in opening[run] if f" {b} " in text)
    return found


def measured(texts: list[list[str]], chunks: list[list[str]], bags: Bags, low: int, high: int, window: int) -> pd.DataFrame:
    """Sums and counts of the four measures for each text, given as sentences, and its chunks."""
    within = [[bags.number(s) for s in sentences(c)] for own in chunks for c in own]
    n = np.array([len(s) for s in within], np.int64)
    rows = bags.of([k for s in within for k in s])
    whole = added(rows)
    ends = np.cumsum(n)
    bag = whole[ends] - whole[ends - n]
    text = np.repeat(np.arange(len(chunks)), [len(own) for own in chunks])
    summed = lambda values, where: np.bincount(text[where], values[where], len(chunks))
    every = np.ones(len(n), bool)
    size = np.array([low <= len(c) <= high for own in chunks for c in own], np.float64)
    out = {"sized": summed(size, every), "chunks": summed(np.ones(len(n)), every)}

    of = np.repeat(np.arange(len(n)), n)
    mean = np.bincount(of, cosines(rows, bag[of]), len(n)) / np.maximum(n, 1)
    out |= {"cohesion": summed(mean, n >= 2), "cohesive": summed(np.ones(len(n)), n >= 2)}

    # a window's cosines with its chunks add up to one product with the sum of the chunks' unit vectors
    length = np.sqrt(dots(bag, bag))
    unit = added(bag / np.where(length == 0, 1, length)[:, None])
    total = added(bag)
    words = bag.sum(axis=1)
    stop = np.cumsum(words)
    last = np.minimum(np.searchsorted(stop, stop - words + window, "right"), np.repeat(np.cumsum([len(own) for own in chunks]), [len(own) for own in chunks]))
    first = np.arange(len(n))
    last = np.maximum(last, first)
    sum_, near = total[last] - total[first], unit[last] - unit[first]
    length = np.sqrt(dots(sum_, sum_))
    close = dots(near, sum_) / np.where(length == 0, 1, length)
    out |= {"coherence": summed(close, last - first >= 2), "coherent": summed((last - first).astype(np.float64), last - first >= 2)}

    stood = []
    for own, cut in zip(texts, chunks):
        blocks = [normalised(s) for s in own]
        found = standing(set(blocks), [normalised(c) for c in cut])
        stood.append(sum(b in found for b in blocks))
    return pd.DataFrame(out | {"whole": np.array(stood, np.float64), "blocks": np.array([len(own) for own in texts], np.float64)})


def gate_metrics(docs: DataFrame, key: str, text: str, budget: int = 512, overlap: int = 64, buffer: int = 2, percent: float = 0.95, low: int = 100, high: int = 512, window: int = 3000) -> DataFrame:
    """(key, strategy, size, whole, cohesion, coherence) of the fixed and the semantic chunks of every text; null where one does not apply.

    They are those of chunking.recursive_chunks and semantic_chunks over hashed vectors, with size_share, whole_blocks (of
    the text's sentences), cohesion and coherence. Texts without chunks give no row; texts with one key are
    cut each by itself and measured together. Only their sums and counts are shuffled.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places()
        for pdf in batches:
            group = (pdf["text"].str.len().cumsum() // TOGETHER).to_numpy()
            for _, some in pdf.groupby(group):
                bags, own = Bags(places), [sentences(t) for t in some["text"]]
                fixed = [split_text(t, budget, overlap) for t in some["text"]]
                semantic = [[c for s in cut for c in split_text(s, budget, overlap)] for cut in segments(own, bags, buffer, percent)]
                for name, chunks in (("fixed", fixed), ("semantic", semantic)):
                    sums = measured(own, chunks, bags, low, high, window)
                    sums.insert(0, "key", some["key"].to_numpy())
                    sums.insert(1, "strategy", name)
                    yield sums[sums["chunks"] > 0]

    sums = ("sized", "chunks", "cohesion", "cohesive", "coherence", "coherent", "whole", "blocks")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    out = rows.mapInPandas(measure, f"key {kind}, strategy string, " + ", ".join(f"{s} double" for s in sums))
    out = out.groupBy("key", "strategy").agg(*[F.sum(s).alias(s) for s in sums])
    mean = lambda a, b: F.least(F.greatest(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    share = [F.when(F.col(n) > 0, mean(s, n)).alias(m) for m, s, n in (("size", "sized", "chunks"), ("whole", "whole", "blocks"), ("cohesion", "cohesion", "cohesive"), ("coherence", "coherence", "coherent"))]
    return out.select(F.col("key").alias(key), "strategy", *share)
