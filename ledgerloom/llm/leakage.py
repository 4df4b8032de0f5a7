"""Evaluation texts leaking into a corpus: latent semantic retrieval with checks of the wording.

Passages (windows of words) of the corpus become TF-IDF vectors over the vocabulary of the held-out
items. A randomised SVD, whose products with the passage matrix Spark sums over all partitions, gives
a latent space; it is fitted on the items' windows and a bounded sample of passages, while the frequencies
cover all of them. Every passage is projected and compared with every window of the items by
cosine. A candidate is a leak if an alignment of its words holds a passage of the item, or if the two
windows' longest common subsequence is that long, however many words are put in between, and the
item's figures stand beside it.

Only passages with too few words of the items' vocabulary to hold a passage are left out before the
search; no pair of neighbouring words need be shared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Words of a window, and from one window's start to the next: every run of 12 words lies in one window.
WINDOW, STRIDE = 20, 8
#: A passage: words of the item in its order.
PASSAGE = 12
#: Words of a window that must be words of items; a passage has this many even if three are changed.
SHARED = 9
#: Words that the two windows of a candidate share at least, whatever their order.
COMMON = 7
#: Dimensions of the latent space, further random directions, and power iterations.
RANK, EXTRA, POWER = 160, 16, 1
#: Passages of the sample on which the space is fitted (taken by hash of the document), about.
FITTED = 30_000
#: Least cosine of a candidate.
COSINE = 0.55
#: Held-out items of one pass over the corpus, and windows of theirs compared at a time.
ITEMS, AT_ONCE = 50_000, 8192
#: Candidates that a task judges at a time.
JUDGED = 20_000

#: Characters without width, which stand inside words.
WIDTHLESS = frozenset("\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
#: Characters beyond ASCII that part words; all others beyond ASCII belong to words.
PARTING = frozenset(filter(re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u3000-\u3003\u3008-\u3020\ufe0f\ufeff\uff01-\uff0f]").match, map(chr, range(0x80, 0x10000)))) - WIDTHLESS
#: Single letters beyond ASCII, which are no words of an item, but what garbled punctuation leaves.
LONE = frozenset(chr(c).encode() for c in range(0x80, 0x800))
#: Marks that are no words: tags of any length and character references.
MARKUP = re.compile(r"</?[a-z](?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*>|&#?\w{2,8};")
BLANKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


#: Words whose stretches are sought at a time.
WORDS = 1_000_000


def parted(text: str) -> list[bytes]:
    """Lower-case words as UTF-8, lone letters included; punctuation, white space and markup signs part them."""
    low = text.lower()
    if "<" in low or "&" in low:
        low = MARKUP.sub(" ", low)
    if not low.isascii():
        # few characters differ, so each is replaced in the whole text
        there = set(low)
        for c in there & WIDTHLESS:
            low = low.replace(c, "")
        for c in there & PARTING:
            low = low.replace(c, " ")
    return low.encode("utf-8", "replace").translate(BLANKS).split()


def tokens(text: str) -> list[bytes]:
    """The words of a text without lone letters."""
    return [w for w in parted(text) if w not in LONE]


def aligned(a: np.ndarray, b: np.ndarray, least: int = PASSAGE) -> np.ndarray:
    """For each row whether b's words hold a passage of a's in order: a local alignment (match 1; changed,
    dropped or put-in word -1) from a match to a match that covers at least `least` words of a and
    scores at least least - 3: twelve words with one of them changed score ten, fifteen with two eleven.
    Rows are padded with numbers that differ on both sides."""
    rows, n = b.shape
    score, start = [np.zeros(rows, np.int32)] * (n + 1), [np.zeros(rows, np.int32)] * (n + 1)
    found = np.zeros(rows, bool)
    columns = np.ascontiguousarray(b.T)
    for i in range(a.shape[1]):
        hit = a[:, i] == columns
        diagonal, diagonal_start = np.zeros(rows, np.int32), np.full(rows, i, np.int32)
        left, left_start = np.zeros(rows, np.int32), np.full(rows, i + 1, np.int32)
        for j in range(n):
            up, up_start = score[j + 1], start[j + 1]
            same = hit[j]
            here = np.where(same, diagonal + 1, diagonal - 1)
            at = np.where(same & (diagonal == 0), i, diagonal_start)
            better = ~same & (up - 1 > here)
            here, at = np.where(better, up - 1, here), np.where(better, up_start, at)
            better = ~same & (left - 1 > here)
            here, at = np.where(better, left - 1, here), np.where(better, left_start, at)
            none = ~same & (here <= 0)
            here, at = np.where(none, 0, here), np.where(none, i + 1, at)
            diagonal, diagonal_start = up, up_start
            score[j + 1], start[j + 1] = left, left_start = here, at
            found |= same & (here >= least - 3) & (i - at + 1 >= least)
    return found


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of a (64 words at most) and b.

    A bit for each word of a; those at which the subsequence grows are cleared (Hyyroe's recurrence).
    """
    out = np.zeros(len(b), np.int32)
    size = -(-a.shape[1] // 8)
    for lo in range(0, len(b), 2000):
        x, y = a[lo : lo + 2000], b[lo : lo + 2000]
        hits, open_ = np.zeros((len(y), 8), np.uint8), np.full(len(y), 2**64 - 1, np.uint64)
        for j in range(y.shape[1]):
            hits[:, :size] = np.packbits(x == y[:, j, None], axis=1, bitorder="little")
            hit = open_ & hits.view("<u8")[:, 0]
            open_ = (open_ + hit) | (open_ - hit)
        out[lo : lo + 2000] = np.bitwise_count(~open_)
    return out


def starts(n: int) -> np.ndarray:
    return np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE)


def places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of all windows of texts with so many words: starts() of each."""
    count = -(-np.maximum(lengths - WINDOW + STRIDE, 1) // STRIDE)
    text = np.repeat(np.arange(len(lengths)), count)
    return text, STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))


class Items:
    """The held-out items of one block: vocabulary, word numbers, windows."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = [tokens(t) for _, t in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        #: what texts are looked up in: -2 for what is no word
        self.numbers = self.vocabulary | dict.fromkeys(LONE, -2)
        self.ids = [i for i, _ in rows]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int32) for ws in words]
        figure = np.array([w.isdigit() for w in sorted(self.vocabulary)] + [False])
        spans = [(k, s) for k, ws in enumerate(self.words) if len(ws) >= PASSAGE for s in starts(len(ws))]
        self.window_item = np.array([k for k, _ in spans], np.int32)
        # the windows alone and with what stands around them; -2 beyond the item
        self.alone = padded([self.words[k] for k, _ in spans], [s for _, s in spans], 0, WINDOW, -2)
        self.around = padded([self.words[k] for k, _ in spans], [s for _, s in spans], WINDOW, 3 * WINDOW, -2)
        self.figures = [np.unique(w[(w >= 0) & figure[w]]) for w in self.alone]


def padded(words: list[np.ndarray], at: list[int], before: int, size: int, other: int) -> np.ndarray:
    """Rows of `size` words of each text from `before` words ahead of a place; `other` beyond the text."""
    out = np.full((len(words), size), other, np.int32)
    for row, (w, s) in enumerate(zip(words, at)):
        lo = max(0, s - before)
        part = w[lo : s - before + size]
        out[row, lo - (s - before) : lo - (s - before) + len(part)] = part
    return out


def able(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of the stretches whose windows can hold a passage, in texts of so many words one after another."""
    text, place = places(lengths)
    ends = np.cumsum(lengths)
    lo = (ends - lengths)[text] + place
    hi = np.minimum(lo + WINDOW, ends[text])
    sums = np.concatenate(([0], np.cumsum(flat >= 0)))
    good = sums[hi] - sums[lo] >= SHARED
    text, lo, hi = text[good], lo[good], hi[good]
    first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(lo, prepend=0) > WINDOW))
    return text[first], lo[first], hi[np.append(first[1:], len(text))[: len(first)] - 1]


def stretches(df: DataFrame, items, key: str, text: str) -> DataFrame:
    """(key, words): the stretches of each text whose windows can hold a passage; -1 is any other word."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items.value.numbers.get

        def cut(keys: pa.Array, rows: list[int], words: list[np.ndarray]) -> pa.RecordBatch:
            flat, lengths = np.concatenate([np.zeros(0, np.int32), *words]), np.array([len(w) for w in words], np.int64)
            at, lo, hi = able(flat, lengths)
            size = hi - lo
            offsets = np.concatenate(([0], np.cumsum(size)))
            flat = flat[np.repeat(lo - offsets[:-1], size) + np.arange(offsets[-1])]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            return pa.RecordBatch.from_arrays([keys.take(pa.array(np.array(rows, np.int64)[at])), lists], names=["key", "words"])

        for batch in batches:
            rows, words, waiting = [], [], 0
            for row, t in enumerate(batch.column(1).to_pylist()):
                ws = parted(t)
                if len(ws) < SHARED:
                    continue
                numbers = np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws))
                rows.append(row)
                words.append(numbers[numbers != -2])
                waiting += len(ws)
                if waiting >= WORDS:
                    yield cut(batch.column(0), rows, words)
                    rows, words, waiting = [], [], 0
            yield cut(batch.column(0), rows, words)

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    return rows.mapInArrow(find, f"key {kind}, words array<int>")


def windows_of(words: list[np.ndarray], before: int = 0, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(text, windows): a row for each window of each text, of `size` words from `before` words ahead of it; -1 beyond the text."""
    lengths = np.array([len(w) for w in words], np.int64)
    text, place = places(lengths)
    beyond = np.full(max(before, size), -1, np.int32)
    flat = np.concatenate([beyond, *(x for w in words for x in (w, beyond))])
    begin = np.cumsum(lengths + len(beyond)) - lengths
    return text, np.lib.stride_tricks.sliding_window_view(flat, size)[begin[text] + place - before]


def terms_of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, terms, counts) of the words in rows of word numbers, in order; numbers below 0 are no terms."""
    order = np.sort(windows, axis=1)
    at = np.flatnonzero((order >= 0) & (np.diff(order, axis=1, prepend=-1) != 0))
    row = at // order.shape[1]
    return row, order.ravel()[at], np.minimum(np.append(at[1:], order.size)[: len(at)], (row + 1) * order.shape[1]) - at


def sparse(windows: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, terms, weights) of the windows' TF-IDF vectors of length 1."""
    row, term, count = terms_of(windows)
    weight = (1 + np.log(count)) * idf[term]
    first = np.searchsorted(row, np.arange(len(windows)))
    norm = np.sqrt(np.bincount(row, weight**2, len(windows)))
    return first, term, (weight / np.maximum(norm, 1e-12)[row]).astype(np.float32)


#: Vocabularies up to this size are multiplied as dense blocks, which is faster there.
DENSE = 4096


def filled(first: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> np.ndarray:
    """The sparse rows as a dense block."""
    out = np.zeros((len(first), terms), np.float32)
    out[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term)))), term] = weight
    return out


def times(first: np.ndarray, term: np.ndarray, weight: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Rows of the sparse matrix times a dense one."""
    if not len(term):
        return np.zeros((len(first), dense.shape[1]), np.float32)
    if len(dense) <= DENSE:
        return filled(first, term, weight, len(dense)) @ dense
    out = np.add.reduceat(dense[term] * weight[:, None], np.minimum(first, len(term) - 1), axis=0)
    out[np.diff(np.append(first, len(term))) == 0] = 0
    return out


def transposed(first: np.ndarray, term: np.ndarray, weight: np.ndarray, dense: np.ndarray, into: np.ndarray) -> None:
    """Adds the transposed sparse matrix times a dense one."""
    if not len(term):
        return
    if len(into) <= DENSE:
        into += filled(first, term, weight, len(into)).T @ dense
        return
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
    order = np.argsort(term, kind="stable")
    begin = np.flatnonzero(np.diff(term[order], prepend=-1))
    into[term[order][begin]] += np.add.reduceat(dense[row[order]] * weight[order][:, None], begin, axis=0)


def blocks(batches: Iterator[pd.DataFrame], size: int = 200) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for pdf in batches:
        for k in range(0, len(pdf), size):
            yield pdf["key"].to_numpy()[k : k + size], [np.asarray(w) for w in pdf["words"][k : k + size]]


def summed(rows: DataFrame, make, height: int, width: int) -> np.ndarray:
    """The sum over all partitions of a matrix that make(block of windows, into) adds to.

    Its size depends on the items' vocabulary and the rank, never on the corpus. Spark adds the
    partitions' matrices row by row; only the sum reaches the driver.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((height, width), np.float32)
        for _, words in blocks(batches):
            make(windows_of(words)[1], total)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame({"row": used, "v": pd.Series(list(total[used]), dtype=object)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.groupby("row")["v"].agg(lambda vs: np.sum(np.stack(list(vs)), axis=0))
        return pd.DataFrame({"row": out.index, "v": list(out)})

    parts = rows.mapInPandas(partial, "row int, v array<float>").groupBy(F.pmod("row", F.lit(64)).alias("part"))
    total = np.zeros((height, width))
    for row, v in parts.applyInPandas(add, "row int, v array<float>").collect():
        total[row] = v
    return total


def latent_space(rows: DataFrame, windows: np.ndarray, passages: int, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the passages' and the items' windows by randomised SVD.

    rows: the sample, of so many passages; the items' windows weigh as much as all of them together.
    """
    terms = len(idf)
    width = min(RANK + EXTRA, terms)
    context = rows.sparkSession.sparkContext
    own = sparse(windows, idf)
    weight = passages / len(windows)
    base = np.random.default_rng(seed).standard_normal((terms, width)).astype(np.float32)
    for _ in range(1 + POWER):
        shared = context.broadcast(base)

        def through(block, into, shared=shared):
            x = sparse(block, idf)
            transposed(*x, times(*x, shared.value), into)

        total, items = summed(rows, through, terms, width), np.zeros((terms, width), np.float32)
        transposed(*own, times(*own, base), items)
        base = np.linalg.qr(total + weight * items)[0].astype(np.float32)
    shared = context.broadcast(base)

    def gram(block, into):
        y = times(*sparse(block, idf), shared.value)
        into += y.T @ y

    y = times(*own, base)
    _, vectors = np.linalg.eigh(summed(rows, gram, width, width) + weight * (y.T @ y))
    return (base @ vectors[:, ::-1][:, :RANK]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def checked(held: Items, item_window: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Which candidates (window of an item; passage with what stands around it) hold a passage of the item."""
    hold = np.zeros(len(around), bool)
    # an alignment that scores enough has as many words in common, in order
    some = np.flatnonzero(common(held.around[item_window], around) >= PASSAGE - 3)
    if len(some):
        hold[some] = aligned(held.around[item_window[some]], around[some])
    # paraphrases: as many words of the item in its order, and all figures of its window near by
    rest = np.flatnonzero(~hold)
    wide = around[rest, WINDOW // 2 : WINDOW // 2 + 2 * WINDOW]
    for k in np.flatnonzero(common(held.alone[item_window[rest]], wide) >= PASSAGE):
        hold[rest[k]] = np.isin(held.figures[item_window[rest[k]]], wide[k]).all()
    return hold


def best_held(held: Items, pair: np.ndarray, near: np.ndarray, item_window: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Of each pair that has candidates which hold, the one with the highest cosine.

    The best of each pair is checked first; the others, only where it doesn't hold.
    """
    order = np.lexsort((-near, pair))
    first = np.diff(pair[order], prepend=-1) != 0
    best, rest = order[first], order[~first]
    good = best[checked(held, item_window[best], around[best])]
    rest = rest[~np.isin(pair[rest], pair[good])]
    rest = rest[checked(held, item_window[rest], around[rest])]
    return np.concatenate((good, rest[np.diff(pair[rest], prepend=-1) != 0]))


def candidates_checked(rows: DataFrame, items, idf: np.ndarray, space: np.ndarray) -> DataFrame:
    """(key, item, cosine) of the stretches that hold a passage: every passage against every window of the items."""
    context = rows.sparkSession.sparkContext
    query = context.broadcast(unit(times(*sparse(items.value.alone, idf), space)).astype(np.float32))
    shared = context.broadcast(space)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, q, basis = items.value, query.value, shared.value
        owner = np.array(held.ids)[held.window_item]
        waiting: list[tuple] = []

        def judged() -> pd.DataFrame:
            out = pd.DataFrame(columns=["key", "item", "cosine"])
            if waiting:
                keys, windows, near, around = (np.concatenate(x) for x in zip(*waiting))
                pair = pd.DataFrame({"key": keys, "item": owner[windows]}).groupby(["key", "item"], sort=False, dropna=False).ngroup().to_numpy()
                good = best_held(held, pair, near, windows, around)
                out = pd.DataFrame({"key": keys[good], "item": owner[windows[good]], "cosine": near[good].astype(float)})
            waiting.clear()
            return out

        for keys, words in blocks(batches):
            text, around = windows_of(words, WINDOW, 3 * WINDOW)
            alone = around[:, WINDOW : 2 * WINDOW]
            passages = unit(times(*sparse(alone, idf), basis)).astype(np.float32)
            for lo in range(0, len(q), AT_ONCE):
                near = (passages @ q[lo : lo + AT_ONCE].T).ravel()
                at = np.flatnonzero(near >= COSINE)
                n, m = np.divmod(at, min(AT_ONCE, len(q) - lo))
                for part in range(0, len(n), 20_000):
                    some_n, some_m = n[part : part + 20_000], m[part : part + 20_000] + lo
                    k = np.flatnonzero(common(held.alone[some_m], alone[some_n]) >= COMMON)
                    if len(k):
                        waiting.append((keys[text[some_n[k]]], some_m[k], near[at[part : part + 20_000][k]], around[some_n[k]]))
                        if sum(len(x[1]) for x in waiting) >= JUDGED:
                            yield judged()
        yield judged()

    return rows.mapInPandas(search, f"key {rows.schema['key'].dataType.simpleString()}, item bigint, cosine double")


def find_leaks(df: DataFrame, held_out: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, cosine): each document with each item of which it holds a passage, once.

    Null, empty and short texts hold nothing; items of under 12 words have no passage; rows that
    come twice count once, a key with several texts counts for all of them; empty tables give an
    empty table. One pass over the corpus serves ITEMS held-out items, which alone are broadcast; more are
    taken in groups of that size.
    """
    spark = df.sparkSession
    held = held_out.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null").distinct()
    n = held.count()
    parts = max(1, -(-n // ITEMS))
    kind = df.schema[key].dataType.simpleString()
    out = None
    for part in range(parts):
        rows = held.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "t").collect()
        block = Items([tuple(r) for r in rows])
        if not len(block.alone):
            continue
        items = spark.sparkContext.broadcast(block)
        regions = cut_lineage(stretches(df, items, key, text))
        terms = len(block.vocabulary)

        def frequency(windows, into):
            into[:, 0] += np.bincount(terms_of(windows)[1], minlength=len(into))
            into[0, 1] += len(windows)

        counts = summed(regions, frequency, terms, 2)
        passages = int(counts[:, 1].sum())
        frequency(block.alone, counts)
        idf = np.maximum(np.log((1 + counts[0, 1]) / (1 + counts[:, 0])), 0.05).astype(np.float32)
        share = min(1.0, FITTED / max(passages, 1))
        sample = regions.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * share))
        space = latent_space(sample, block.alone, max(int(passages * share), 1), idf)
        hits = candidates_checked(regions, items, idf, space)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], f"{key} {kind}, item bigint, cosine double")
    return out.groupBy(F.col("key").alias(key), "item").agg(F.max("cosine").alias("cosine"))
