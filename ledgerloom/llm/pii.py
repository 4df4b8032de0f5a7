"""Personal information in free text: a skip-chain conditional random field with loopy message passing.

Tokens are the nodes. Node potentials are log-linear in general features: the spelling's shape, ending
and letter case over the corpus, the words around it, its place in a run of capitalised words or in a
line, and the formats of mail addresses, numbers and streets that it lies in. Neighbours share transition
potentials. Tokens of a text that repeat a spelling, with a possessive or one letter changed too, share
a skip potential, so that a mention that stands alone takes the label of one that is clear. Beliefs come
from exact passes along the chain in turn with messages over the skip edges.

Spark counts over every text how often a word is capitalised and how often it is part of a person's name
where that is evident (in mail addresses, after titles, in signatures). The potentials are fitted on a
bounded sample by the likelihood of partly labelled chains: what is evident has one label, what is not
leaves several open and is summed over. Each sample text is taken twice, once as if its names
had never been counted, so that the field knows names that are new to it by what stands around them.
Check digits alone are hard rules.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Tokens after which a capital letter says little.
STOPS = {".", "!", "?", "\n", '"', "“", "(", ":", ";"}
#: Tokens that may stand between the groups of a number.
JOINING = {"-", ".", "(", ")", "–"}
LABELS = ("O", "EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
O, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
#: Rows (taken by hash of the text) among which those to fit the field on are chosen, how many of them hold
#: a name or a format at most, how many neither, and passes over them.
POOL, SAMPLE, PLAIN, PASSES = 20_000, 3000, 500, 8
#: Names and other words that the lexicon may hold; it is broadcast. Rarer words count as unknown.
NAMES, WORDS = 500_000, 100_000
#: A word is a feature of its own if it is among the most frequent ones and occurs this often.
SPELLED_OUT, OFTEN = 5000, 20
#: In what share of its uses a word must be part of an evident name, and in what share it may stand in lower case.
SHARE, LOWER = 0.02, 0.5
#: Rounds of message passing.
ROUNDS = 4
#: Skip potentials lie between minus and plus TIE; so many linked pairs of each label are taken to agree beforehand.
TIE, AGREE = 4.0, 10.0

#: Every character lies in a token; white space other than line ends is dropped after the offsets are known.
TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]|_|\n|[^\S\n]+")
CAP = r"[A-Z][\w'’]*(?:-[A-Z]\w+)?"
# What a person's name follows in letters and filings of any kind.
TITLED = r"\b(?:Mr|Mrs|Ms|Dr|Shri|Smt|Prof)\.? "
EVIDENT = rf"(?:{TITLED}|\b[Mm]y name is |\b[Ss]igned by:? |/s/ |\b[Aa]ttn:? |(?:[Rr]egards|[Ss]incerely),\s+)({CAP}(?: [A-Z]\.)? {CAP}|{CAP}, {CAP})"
NAMED = re.compile(EVIDENT)
BOX, PARTS, WORD = re.compile(r"([\w.-]+)(?:\+[\w.-]*)?@"), re.compile(r"[._\d-]+"), re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

MAIL = re.compile(r"[\w.+'-]+@[\w-]+(?:\.[\w-]+)+|[\w.+'-]+ ?@ ?[A-Z][\w-]*(?:\.[\w-]*[A-Z][\w-]*)+|[\w.+'-]+ ?(?:\(at\)|\[at\]) ?[\w-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[\w-]+)+|[\w.+'-]+ at [\w-]+(?:(?:\.| dot )[\w-]+)* dot [\w-]+", re.I)
NUMBER = re.compile(r"(?<![\w.,/#-])(?:\+|\()?\d(?:[\d ().-]{6,24})\d(?![\w%/]|[.,-]\d|:\d)(?: ?(?:ext|x|extn)\.? ?\d+)?", re.I)
PHONE_FORM = re.compile(r"\+\d{1,3}[ -]?\(?\d[\d ().-]{6,14}|\(0?\d{2,4}\) ?\d{3,4}[ -]\d{3,4}|\d{3}([-.])\d{3}\1\d{4}|0\d{3,4} \d{5,7}|00\d{2} ?\d{8,11}|[6-9]\d{4} \d{5}|\d{3} \d{3} \d{4}")
STRONG_PHONE = re.compile(r"\+\d|\(0?\d{2,4}\)|\d{3}([-.])\d{3}\1\d{4}|0\d{4} \d{6}|00\d{2} |[6-9]\d{4} \d{5}$")
CALL = re.compile(r"(?:\btel\b|telephone|phone|\bcall\b|\btext\b|whatsapp|mobile|\bcell\b|\bdesk\b|reach me|\bring\b|\bline is\b|no answer|\bfax\b|\bor\b|hotline|dial|contact)[^\d]{0,18}$", re.I)
AFTER_MAIL = re.compile(r"(?:@[\w.-]+|dot \w+)\s*(?:[,;/|-]|–)\s*(?:tel|phone)?[:.]?\s*$", re.I)
SIGNED = re.compile(r"(?:regards|thanks|thx|sincerely|best|-- ?)[^\d]{0,60}\n\s*$", re.I)
UNITS = re.compile(r"\s*(?:units|shares|tonnes|lots|pieces|\$|USD)", re.I)
SHAPES = (
    ("pan", re.compile(r"(?<!\w)[A-Z]{5}\d{4}[A-Z](?!\w)", re.I), re.compile(r"\bpan\b", re.I)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])"), re.compile(r"\bssn\b|social security", re.I)),
    ("aadhaar", re.compile(r"(?<![\w-])\d{4}([- ]?)\d{4}\1\d{4}(?![\w-])"), re.compile(r"aadh?aa?r|\buid(?:ai)?\b", re.I)),
    ("passport", re.compile(r"(?<!\w)[A-Z]\d{7,8}(?!\w)|(?<!\w)\d{9}(?!\w)", re.I), re.compile(r"passport", re.I)),
    ("voter", re.compile(r"(?<!\w)[A-Z]{3}\d{7}(?!\w)", re.I), re.compile(r"voter|\bepic\b|election", re.I)),
    ("card", re.compile(r"(?<![\w-])\d{4}(?:([- ]?)\d{4}\1\d{4}\1\d{1,7}|[- ]\d{6}[- ]\d{5})(?![\w-])|(?<![\w-])\d{13,19}(?![\w-])"), re.compile(r"\bcard\b|\bvisa\b|mastercard|\bamex\b|credit", re.I)),
    ("nino", re.compile(r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)", re.I), re.compile(r"national insurance|\bnino?\b", re.I)),
    ("tax", re.compile(r"(?<![\w-])\d{2,3}[- ]?\d{3}[- ]?\d{3,4}(?![\w-])"), re.compile(r"\b(?:tin|itin|tax (?:id|number|no\.?)|utr)\b", re.I)),
)
ID_WORD = re.compile("|".join(c.pattern for _, _, c in SHAPES), re.I)
ROAD = r"(?:Drive|Dr|Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Close|Way|Boulevard|Blvd|Place|Terrace|Square|Crescent|Marg|Nagar|Vihar|Cross|Colony|Layout|Bend|Hill|Row|Walk|Gardens|Park)"
STREET = re.compile(
    rf"(?<![\w.,$€£₹-])\d{{1,5}}[A-Za-z]?,?\s+((?:(?:N|S|E|W|North|South|East|West)\.?\s+)?(?:[A-Za-z'’-]+\s+){{1,4}}{ROAD}\b)(\.?(?:,?\s+(?:Suite|Apt|Unit|Flat|Floor|Ste|#)\.?\s*\w+)?"
    rf"(?:\s*,\s*|\s+))(?!(?:depot|moved|and|was|is|the|for|came|has|had|in|on|at|to|by|with|of)\b)([A-Za-z][\w'-]{{2,}}(?: [A-Z][\w'-]+)?)(?:\s*,?\s*(?:[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?|[A-Z]\d{{1,2}}\s*\d[A-Z]{{2}}|-?\s*\d{{6}}))?",
    re.I,
)
HOUSE = re.compile(r"(?<!\w)(?:H\.? ?No\.?|House No\.?|Flat|Plot|Door No\.?)\s*\d[\w/-]*,\s*(?:[\w' -]{2,40},\s*){1,3}[A-Za-z][\w' -]{2,30}?(?:\s*-?\s*\d{6}|(?=[\s.,;)]|$))", re.I)
LONG_NUMBER = re.compile(r"\d[\d ().-]{6,}\d|[A-Za-z]\d{4,}")

#: Words that a text must hold for a format to be looked for.
HINTS = ({"@", "dot"}, {r.lower() for r in ROAD[3:-1].split("|")}, {"h", "house", "flat", "plot", "door"})
#: Columns of a spelling's flags.
BLANK, ALPHA, JOINS, DIGITS, AT = 9, 10, 11, 12, 13
#: Places of the weights: spellings are hashed, the other features have a place for each value.
HASHED = 1 << 15
FORMATS = ("mail", "address", "phone", "phone_cue", "id_named", "id_shape", "id_void")
PLACES = {"run": 150, "pair": 64, "pair_before": 64, "mail": 2, "address": 2, "phone": 8, "id": 3}
START = dict(zip(PLACES, HASHED + np.cumsum([0, *PLACES.values()])[:-1]))
TOTAL = HASHED + sum(PLACES.values())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of ten elements."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def verhoeff(digits: str) -> bool:
    """Check digit of Verhoeff's scheme: the permutation is applied once more at each place."""
    step, check, power = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), 0, list(range(10))
    for c in reversed(digits):
        check = dihedral(check, power[int(c)])
        power = [step[p] for p in power]
    return check == 0


def in_town(m: re.Match) -> bool:
    """Whether a town follows the street: in capitals if the street is, and not in a new sentence."""
    street, between, town = m.group(1), m.group(2), m.group(3)
    if between.startswith(". ") and not re.search(r"(?:Dr|St|Rd|Ave|Ln|Ct|Cl|Blvd)$", street, re.I):
        return False
    return town[0].isupper() or not re.search(r"[A-Z][a-z]", street)


def formats(text: str, hints: int = 15) -> dict[str, list[tuple[int, int]]]:
    """Where the formats of mail addresses, numbers and streets stand; id_void: a check digit is wrong."""
    out: dict[str, list[tuple[int, int]]] = {}
    if hints & 1:
        out["mail"] = [m.span() for m in MAIL.finditer(text)]
    if hints & 8:
        sure, other, void = [], [], []
        named_at_all = ID_WORD.search(text)
        for name, shape, cue in SHAPES:
            if name not in ("aadhaar", "card") and not named_at_all:
                continue
            for m in shape.finditer(text):
                a, b = m.span()
                digits = re.sub(r"\D", "", m.group())
                named = named_at_all and (cue.search(text, max(0, a - 32), a) or re.match(rf"\s*\(\s*(?:{cue.pattern})", text[b : b + 30], re.I))
                if named and (name == "aadhaar" and not verhoeff(digits) or name == "card" and not (13 <= len(digits) <= 19 and luhn(digits))):
                    void.append((a, b))
                else:
                    (sure if named else other).append((a, b))
        out["id_named"], out["id_shape"] = sure, other
        out["id_void"] = [(a, b) for a, b in void if (a, b) not in sure]
        out["phone"], out["strong"], out["plain"], out["phone_cue"] = [], [], [], []
        for m in NUMBER.finditer(text):
            a, b = m.span()
            if m.group()[0] == "(" and ")" not in m.group():
                a += 1
            core = re.sub(r" ?(?:ext|x|extn)\.? ?\d+$", "", text[a:b].strip(), flags=re.I)
            digits = re.sub(r"\D", "", core)
            if not 10 <= len(digits) <= 14 or UNITS.match(text[b : b + 8]) or any(a < d and c < b for c, d in sure):
                continue
            if PHONE_FORM.fullmatch(core):
                out["strong" if STRONG_PHONE.match(core) else "phone"].append((a, b))
            elif core.isdigit():
                out["plain"].append((a, b))
            if CALL.search(text[max(0, a - 40) : a]) or AFTER_MAIL.search(text[max(0, a - 60) : a]) or SIGNED.search(text[max(0, a - 80) : a]):
                out["phone_cue"].append((a, b))
    streets = [m.span() for m in STREET.finditer(text) if in_town(m)] if hints & 2 else []
    out["address"] = streets + ([m.span() for m in HOUSE.finditer(text)] if hints & 4 else [])
    return out


def letters(word: str) -> str:
    """A word's key: its letters in lower case, without a possessive."""
    low = word.lower().replace("’", "'")
    return low.removesuffix("'s").replace("'", "").replace("-", "")


class Spellings:
    """What the field knows of each spelling that a task has met: feature places and flags, kept once.

    lexicon: word key to (bits, lower-case share in tenths, frequent); bits has 1 for given names, 2 for
    surnames, 4 for parts of mail addresses. With blind, name bits count as never seen.
    """

    OWN, AROUND = 6, 2
    MOST = 300_000

    def __init__(self, lexicon: dict[str, tuple[int, int, bool]], blind: bool = False):
        self.lexicon, self.blind = lexicon, blind
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.own, self.around, self.flags = [], [], []
        self.keys: list[str] = []
        self.arrays = None
        self.add("")

    def add(self, w: str) -> int:
        key = letters(w)
        bits, lower, frequent = self.lexicon.get(key, (0, -1, False))
        if self.blind and bits:
            bits, lower, frequent = 0, -1, False
        alpha = w[:1].isalpha()
        shape = "A" if alpha and len(w) > 1 and w.isupper() else "a" if alpha and w[0].islower() else "I" if alpha and len(w) == 1 else "Aa" if alpha else f"9{min(len(w), 9)}" if w.isdigit() else w
        if "-" in w or "'" in w:
            shape += "-"
        word = key if frequent and alpha else shape if not alpha else "?" + shape[:1] + ("" if lower < 0 else "k")
        at = lambda slot, v: zlib.crc32(f"{slot}|{v}".encode()) % HASHED
        self.own.append([at(0, ""), at(1, shape), at(2, f"{shape}{lower}"), at(3, f"{bits}{shape[:1]}"), at(4, key[-3:] if alpha else shape), at(5, word)])
        self.around.append([[at(10 + 2 * k, word), at(11 + 2 * k, f"{bits}{shape[:1]}{lower >= 5}")] for k in range(4)])
        common = lower >= 5
        self.flags.append((bits, alpha and w[0].isupper() and len(w) > 1, alpha and len(w) == 1, w == ".", alpha and w[0].islower() and not common, frequent and not bits, common, w in STOPS, sum(1 << k for k, h in enumerate(HINTS) if w.lower() in h), w.isspace() and w != "\n", alpha, w in JOINING, w[:1].isdigit(), w.lower() == "at"))
        self.keys.append(key)
        self.of[w] = len(self.keys) - 1
        return self.of[w]

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.of) > self.MOST:
            self.clear()
        get = self.of.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            before = len(self.keys)
            out = [i if i >= 0 else self.of[w] if w in self.of else self.add(w) for i, w in zip(out, words)]
            new = slice(before if self.arrays else 0, None)
            fresh = [np.array(self.own[new], np.int32), np.array(self.around[new], np.int32), np.array(self.flags[new], np.int8)]
            self.arrays = fresh if self.arrays is None else [np.concatenate(p) for p in zip(self.arrays, fresh)]
            self.own[new], self.around[new], self.flags[new] = ([None] * len(fresh[0]),) * 3
        return np.array(out, np.int32)


class Tokens:
    """The tokens of many texts in one line, with what the field sees of them."""

    def __init__(self, texts: list[str], spellings: Spellings):
        pieces = [TOKEN.findall(t) for t in texts]
        flat = [w for p in pieces for w in p]
        word = spellings.ids(flat) if flat else np.zeros(0, np.int32)
        text = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
        end = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
        length = np.diff(end, prepend=0)
        end -= np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1][text] if flat else 0
        keep = spellings.arrays[2][word, BLANK] == 0 if flat else np.zeros(0, bool)
        self.word, self.text, self.begin, self.end = word[keep], text[keep], (end - length)[keep], end[keep]
        self.n = n = len(self.word)
        self.sizes = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.format = np.zeros((len(FORMATS), n), np.int8)
        hints = np.zeros(len(texts), np.int8)
        if n:
            np.bitwise_or.at(hints, self.text, spellings.arrays[2][self.word, 8])
            hints |= self.long_numbers(spellings, len(texts))
            at = np.flatnonzero(spellings.arrays[2][self.word, AT])
            opening = [spellings.of.get("(", -1), spellings.of.get("[", -1)]
            hints[self.text[at[np.isin(self.word[np.maximum(at - 1, 0)], opening)]]] |= 1
            # streets and houses have numbers
            digits = np.zeros(len(texts), bool)
            digits[self.text[spellings.arrays[2][self.word, DIGITS] > 0]] = True
            hints[~digits] &= 1
        value = {"strong": 2, "plain": 3}
        for k in np.flatnonzero(hints):
            lo, hi = self.first[k], self.first[k + 1]
            for f, found in formats(texts[k], int(hints[k])).items():
                for a, b in found:
                    inside = slice(lo + np.searchsorted(self.begin[lo:hi], a), lo + np.searchsorted(self.begin[lo:hi], b))
                    self.format[FORMATS.index("phone" if f in value else f), inside] = value.get(f, 1)
        self.see(spellings)

    def long_numbers(self, spellings: Spellings, texts: int) -> np.ndarray:
        """8 for each text with seven digits or three groups of them in a row, or digits within a word."""
        flags = spellings.arrays[2]
        alpha, joins = flags[self.word, ALPHA] > 0, flags[self.word, JOINS] > 0
        d = np.flatnonzero(flags[self.word, DIGITS])
        out = np.zeros(texts, np.int8)
        if len(d):
            gap = np.diff(d)
            linked = (self.text[d[1:]] == self.text[d[:-1]]) & (self.begin[d[1:]] - self.end[d[:-1]] <= 3) & ((gap == 1) | (gap <= 3) & joins[d[1:] - 1])
            chain = np.concatenate(([0], np.cumsum(~linked)))
            many = np.bincount(chain, self.end[d] - self.begin[d])[chain] >= 7
            many |= np.bincount(chain)[chain] >= 3
            before, after = np.maximum(d - 1, 0), np.minimum(d + 1, self.n - 1)
            many |= alpha[before] & (self.end[before] == self.begin[d]) & alpha[after] & (self.begin[after] == self.end[d])
            out[self.text[d[many]]] = 8
        return out

    def see(self, spellings: Spellings) -> None:
        n, flags = self.n, spellings.arrays[2] if spellings.arrays else np.zeros((1, 14), np.int8)
        bits, cap, single, dot, lower, known, common, stop = flags[self.word].T[:8] if n else np.zeros((8, 0), np.int8)
        same = np.zeros(n, bool)
        same[1:] = (self.text[1:] == self.text[:-1]) & (self.begin[1:] - self.end[:-1] <= 1)
        self.mail = self.format[0] > 0
        opens = np.ones(n, bool)  # a sentence, line or text
        opens[1:] = (stop[:-1] > 0) | (self.text[1:] != self.text[:-1])
        cap = (cap > 0) & ~(opens & (common > 0))
        initial_dot = np.zeros(n, bool)
        initial_dot[1:] = (dot[1:] > 0) & (single[:-1] > 0) & (self.begin[1:] == self.end[:-1])
        self.initial = initial_dot
        upper = np.zeros(n, bool)
        upper[:-1] = initial_dot[1:] & (single[:-1] > 0)
        member = (cap | upper | initial_dot) & ~self.mail
        goes_on = np.zeros(n, bool)
        goes_on[1:] = member[1:] & member[:-1] & same[1:]
        run = np.cumsum(~goes_on) - 1
        caps = cap & member
        long = np.bincount(run, caps, minlength=1).astype(np.int64)[run] * member if n else np.zeros(0, np.int64)
        named = np.bincount(run, caps & (bits > 0), minlength=1).astype(np.int64)[run] * member if n else np.zeros(0, np.int64)
        strange = np.bincount(run, caps & ((known > 0) | (common > 0)), minlength=1)[run] == 0 if n else member
        total = np.cumsum(caps)
        head = np.zeros(n, np.int64)
        if n:
            firsts = np.flatnonzero(~goes_on)
            head = (total - caps)[firsts][run]
        place = np.where(member, np.clip(total - 1 - head, 0, 2), 0)
        self.bits, self.member, self.long, self.named, self.caps, self.same, self.lower, self.strange = bits, member, long, named, caps, same, lower > 0, strange & member
        after, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n:
            after[:-1] = np.where(same[1:], bits[1:], 0)
            before[1:] = np.where(same[1:], bits[:-1], 0)
        kind = np.where(self.format[4] > 0, 2, self.format[5] > 0)
        self.small = np.stack(
            [
                START["run"] + np.minimum(long, 4) * 15 + place * 5 + np.where(long > 0, np.minimum(named, 2), 3 + (lower > 0)) + 75 * (member & ~strange),
                START["pair"] + bits * 8 + after,
                START["pair_before"] + bits * 8 + before,
                START["mail"] + self.mail,
                START["address"] + self.format[1],
                START["phone"] + self.format[2] * 2 + self.format[3],
                START["id"] + kind,
            ],
            axis=1,
        ).astype(np.int32)

    def neighbours(self) -> list[np.ndarray]:
        """Spellings two before, one before, one after and two after; 0 beyond the text."""
        out = []
        for d in (-2, -1, 1, 2):
            w, to = np.zeros(self.n, np.int32), np.clip(np.arange(self.n) + d, 0, max(self.n - 1, 0))
            inside = (self.text[to] == self.text) & (to == np.arange(self.n) + d) if self.n else np.zeros(0, bool)
            w[inside] = self.word[to[inside]]
            out.append(w)
        return out

    def places(self, spellings: Spellings) -> np.ndarray:
        """Feature places of each token, one column for each feature."""
        own, around, _ = spellings.arrays
        return np.concatenate([own[self.word], *[around[w, k] for k, w in enumerate(self.neighbours())], self.small], axis=1)

    def scores(self, spellings: Spellings, model: Model) -> np.ndarray:
        """Node potentials; what a spelling adds as itself and as a neighbour is summed once per spelling."""
        own, around, _ = spellings.arrays
        w = model.weights
        out = w[own].sum(axis=1)[self.word]
        for k, other in enumerate(self.neighbours()):
            out += w[around[:, k]].sum(axis=1)[other]
        for column in self.small.T:
            out += w[column]
        out[self.format[6] > 0, ID] = -30  # a wrong check digit
        return out

    def open_labels(self, texts: list[str], comma_id: int, blind: bool) -> np.ndarray:
        """Labels that each token of a training text may have: one where it is evident."""
        able = np.zeros((self.n, 6), bool)
        able[:, O] = True
        pair, maybe = np.zeros(self.n, bool), np.zeros(self.n, bool)
        # two capitalised name parts that make up a run; a word seen often as no name makes the run none
        pair |= self.member & (self.long == 2) & (self.named == 2)
        given, surname, low = self.bits & 1 > 0, self.bits & 2 > 0, self.lower & (self.bits > 0)
        for d in (1, 3):  # next to each other, or with an initial and its dot between
            if self.n > d:
                near = self.text[d:] == self.text[:-d]
                for j in range(1, d + 1):
                    near &= self.same[j : self.n - d + j]
                if d == 3:
                    near &= self.initial[2 : self.n - 1]
                small = near & low[:-d] & low[d:]
                # in a run with strangers only a given name before a surname counts
                large = near & self.caps[:-d] & self.caps[d:] & given[:-d] & ~surname[:-d] & surname[d:] & ~given[d:] & (self.long[d:] >= 3)
                for j in range(d + 1):
                    (maybe if blind else pair)[j : self.n - d + j] |= large
                    pair[j : self.n - d + j] |= small
        if self.n > 2:  # surname, given name
            comma = surname[:-2] & given[2:] & (self.word[1:-1] == comma_id) & (self.text[2:] == self.text[:-2])
            comma &= self.caps[:-2] & self.caps[2:] & (self.long[:-2] == 1) | low[:-2] & low[2:]
            for j in range(3):
                pair[j : self.n - 2 + j] |= comma
        for k, t in enumerate(texts):
            lo, hi = self.first[k], self.first[k + 1]
            for m in NAMED.finditer(t):
                a, b = m.span(1)
                pair[lo + np.searchsorted(self.begin[lo:hi], a) : lo + np.searchsorted(self.begin[lo:hi], b)] = True
        alone = self.member & (self.long == 1) & (self.named == 1) | self.member & (self.long >= 3) & (self.named == self.long) | self.strange & (self.long == 2) | maybe
        mail, address, phone, cue, named, shape, void = self.format
        able[alone, NAME] = True
        able[(phone == 1) & (cue == 0), PHONE] = True
        for on, label in ((pair, NAME), (address > 0, ADDRESS), ((phone == 2) | (phone > 0) & (cue > 0), PHONE), ((named > 0) & (void == 0), ID), (mail > 0, EMAIL)):
            able[on] = False
            able[on, label] = True
        return able


class Model:
    """Weights, transitions and skip potentials, with the lexicon."""

    def __init__(self, lexicon, weights, transitions, skip):
        self.lexicon, self.weights, self.transitions, self.skip = lexicon, weights, transitions, skip


def chains(node: np.ndarray, lengths: np.ndarray, t: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(marginals of each node, expected counts of neighbouring labels) of padded chains, by exact passes."""
    b, n, k = node.shape
    u = np.exp(np.maximum(node - node.max(axis=2, keepdims=True), -60)).transpose(1, 0, 2).copy()
    forth, back = np.empty_like(u), np.ones_like(u)
    forth[0] = u[0] / u[0].sum(axis=1, keepdims=True)
    for i in range(1, n):
        f = (forth[i - 1] @ t) * u[i]
        forth[i] = f / f.sum(axis=1, keepdims=True)
    for i in range(n - 2, -1, -1):
        g = (back[i + 1] * u[i + 1]) @ t.T
        back[i] = np.where((i + 1 < lengths)[:, None], g / g.sum(axis=1, keepdims=True), 1.0)
    belief = forth * back
    belief /= belief.sum(axis=2, keepdims=True)
    counts = None
    if pairs:
        counts = np.zeros((k, k))
        for i in range(n - 1):
            live = i + 1 < lengths
            g = back[i + 1] * u[i + 1]
            z = ((forth[i] @ t) * g).sum(axis=1, keepdims=True)
            counts += ((forth[i] / z)[live].T @ g[live]) * t
    return belief.transpose(1, 0, 2), counts


def skip_edges(words: list[str]) -> list[tuple[int, int]]:
    """Each token with the one before of the same letters or, from six letters, with one letter more, less
    or changed; words of under three letters have none. A chain per spelling, so never all pairs."""
    last: dict[str, int] = {}
    out = []
    for k, w in enumerate(words):
        key = letters(w)
        if len(key) < 3 or not key.isalpha():
            continue
        marks = [key] + ([key[:i] + "*" + key[i + 1 :] for i in range(len(key))] + [key[:i] + key[i + 1 :] for i in range(len(key))] if len(key) >= 6 else [])
        before = max((last[m] for m in marks if m in last), default=None)
        if before is not None:
            out.append((before, k))
        for m in marks:
            last[m] = k
    return out


def prior() -> np.ndarray:
    """What the weights are before any text is seen: a format speaks for its label, its absence against it."""
    w = np.zeros((TOTAL, 6))
    for name, label, no, yes in (("mail", EMAIL, [0], [1]), ("address", ADDRESS, [0], [1]), ("phone", PHONE, [0, 1], [4, 5]), ("id", ID, [0], [2])):
        w[[START[name] + v for v in no], label] = -6
        w[[START[name] + v for v in yes], label] = 6
    return w


def fit(texts: list[str], lexicon: dict[str, tuple[int, int, bool]], passes: int = PASSES, seed: int = 5) -> Model:
    """Potentials by gradient steps on the likelihood of the open labels against all labels."""
    weights, trans = prior().copy(), np.zeros((6, 6))
    start = weights.copy()
    places, able, cuts = [], [], []
    joint = np.diag(np.full(6, AGREE))
    seen, blind = Spellings(lexicon), Spellings(lexicon, blind=True)
    tokens = Tokens(texts, seen)
    if not tokens.n:
        return Model(lexicon, weights, trans, trans)
    comma = seen.of.get(",", -1)
    again = Tokens(texts, blind)
    first = [int(a) for t in range(len(texts)) for a in range(tokens.first[t], tokens.first[t + 1], 60)]
    size = [min(60, int(tokens.first[tokens.text[a] + 1]) - a) for a in first]
    for k, tk in enumerate((tokens, again)):
        places.append(tk.places((seen, blind)[k]))
        able.append(tokens.open_labels(texts, comma, blind=k == 1))
        busy = able[k][:, 1:].any(axis=1) | (tokens.bits > 0)
        cuts += [(k * tokens.n + a, s) for n, (a, s) in enumerate(zip(first, size)) if n % 8 == 0 or busy[a : a + s].any()]
    places, able = np.concatenate(places), np.concatenate(able)
    order = np.random.default_rng(seed)
    m, v, mt, vt, step = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans), 0
    for _ in range(passes):
        turn = order.permutation(len(cuts))
        for lo in range(0, len(cuts), 96):
            part = [cuts[i] for i in turn[lo : lo + 96]]
            lengths = np.array([s for _, s in part])
            spot = np.array([a for a, _ in part])[:, None] + np.arange(lengths.max())
            valid = np.arange(lengths.max()) < lengths[:, None]
            rows = spot[valid]
            node = np.zeros((*valid.shape, 6))
            node[valid] = weights[places[rows]].sum(axis=1)
            t = np.exp(trans)
            free, pairs_free = chains(node, lengths, t, True)
            held = node.copy()
            held[valid] = np.where(able[rows], node[valid], -1e9)
            bound, pairs_bound = chains(held, lengths, t, True)
            g_node = (free - bound)[valid] / len(part)
            g = np.stack([np.bincount(places[rows].ravel(), np.repeat(g_node[:, c], places.shape[1]), TOTAL) for c in range(6)], axis=1) + 1e-5 * (weights - start)
            gt = (pairs_free - pairs_bound) / len(part) + 1e-4 * trans
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
            rate = 0.1 / (1 + step / 300)
            weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            trans -= rate * (mt / (1 - 0.9**step)) / (np.sqrt(vt / (1 - 0.99**step)) + 1e-6)
    # skip potentials, piecewise: how much more often linked tokens have two labels than any two tokens
    one = able[: tokens.n].sum(axis=1) == 1
    label = able[: tokens.n].argmax(axis=1)
    for t in range(len(texts)):
        lo, hi = tokens.first[t], tokens.first[t + 1]
        for i, j in skip_edges([seen.keys[w] for w in tokens.word[lo:hi]]):
            if one[lo + i] and one[lo + j]:
                joint[label[lo + i], label[lo + j]] += 1
                joint[label[lo + j], label[lo + i]] += 1
    share = np.bincount(label[one], minlength=6) + 1
    share = share / share.sum()
    chance = np.outer(share, share)
    skip = np.clip(np.log((joint + 50 * chance) / (joint.sum() + 50) / chance), -TIE, TIE)
    return Model(lexicon, weights.astype(np.float32), trans, skip)


def beliefs(node: np.ndarray, lengths: np.ndarray, model: Model, edges: np.ndarray) -> np.ndarray:
    """Loopy sum-product over padded chains: exact passes along each chain in turn with messages over the
    skip edges. edges: rows (chain, earlier node, later node)."""
    t, ties = np.exp(model.transitions), np.exp(model.skip)
    if not len(edges):
        return chains(node, lengths, t)[0]
    c, i, j = edges.T
    to_later, to_earlier = np.zeros((len(edges), 6)), np.zeros((len(edges), 6))
    now = node
    for step in range(ROUNDS):
        belief = chains(now, lengths, t)[0]
        if step == ROUNDS - 1:
            break
        for ends, told, came in ((i, to_later, to_earlier), (j, to_earlier, to_later)):
            # what one end believes without what the other told it
            q = np.maximum(belief[c, ends], 1e-12) * np.exp(-came)
            message = np.log((q / q.sum(axis=1, keepdims=True)) @ ties)
            told += 0.5 * (message - message.mean(axis=1, keepdims=True) - told)
        now = node.copy()
        np.add.at(now, (c, j), to_later)
        np.add.at(now, (c, i), to_earlier)
    return belief


def decode(texts: list[str], model: Model, spellings: Spellings | None = None, skips: bool = True) -> list[list[tuple[int, int, int]]]:
    """(start, end, label) of the entities of each text, in order. skips: whether skip edges count."""
    spellings = spellings or Spellings(model.lexicon)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    tokens = Tokens(texts, spellings)
    if not tokens.n:
        return out
    node = tokens.scores(spellings, model)
    margin = node[:, 1:].max(axis=1) - node[:, O]
    # what neighbours and skip edges can add to a token at most; below it no label but O can win
    t = model.transitions
    most = max((t[1:, 1:] - t[O, O]).max(), (t[O, 1:] - t[O, O]).max() + (t[1:, O] - t[O, O]).max(), 0)
    tied = tokens.member | tokens.lower
    open_ = margin + most + np.where(tied, model.skip.max() if skips else 0, 0) > 0
    live = np.unique(tokens.text[open_])
    live = live[np.argsort(tokens.sizes[live], kind="stable")]
    label = np.zeros(tokens.n, np.int64)
    at = 0
    while at < len(live):
        upto = at + 1
        while upto < len(live) and tokens.sizes[live[upto]] * (upto - at + 1) <= 60_000:
            upto += 1
        part, at = live[at:upto], upto
        lengths = tokens.sizes[part]
        spot = tokens.first[part][:, None] + np.arange(lengths.max())
        valid = np.arange(lengths.max()) < lengths[:, None]
        padded = np.zeros((*valid.shape, 6))
        padded[valid] = node[spot[valid]]
        edges = []
        if skips:
            for row, k in enumerate(part):
                lo = tokens.first[k]
                some = np.flatnonzero(tied[lo : lo + tokens.sizes[k]])
                if len(some) > 1:
                    edges += [(row, some[a], some[b]) for a, b in skip_edges([spellings.keys[w] for w in tokens.word[lo + some]])]
        label[spot[valid]] = beliefs(padded, lengths, model, np.array(edges, np.int64).reshape(-1, 3)).argmax(axis=2)[valid]
    joint = np.zeros(tokens.n, bool)
    joint[1:] = (label[1:] == label[:-1]) & (tokens.text[1:] == tokens.text[:-1])
    for a in np.flatnonzero((label > 0) & ~joint):
        b = a
        while b + 1 < tokens.n and joint[b + 1]:
            b += 1
        k, lab = tokens.text[a], int(label[a])
        text = texts[k]
        start, end = int(tokens.begin[a]), int(tokens.end[b])
        if lab == NAME:
            start += len(text[start:end]) - len(text[start:end].lstrip(" ,.;:-\"'\n"))
            end -= len(text[start:end]) - len(text[start:end].rstrip(" ,.;:-\"'\n")) if start < end else 0
        if start < end:
            out[k].append((start, end, lab))
    return out


def replaced(text: str, found: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, lab in found:
        out += (text[at:a], f"[{LABELS[lab]}]")
        at = b
    return "".join(out) + text[at:]


def counted(texts: DataFrame) -> DataFrame:
    """(key, n, low, given, surname, mail): each word's uses, those in lower case, and those as part of an
    evident name. One pass; a task adds up what its rows hold before anything is shuffled."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, parts = Counter(), Counter()

        def rows() -> pd.DataFrame:
            held: dict[str, list[int]] = {}
            for w, n in words.items():
                row = held.setdefault(letters(w), [0, 0, 0, 0, 0])
                row[0] += n
                row[1] += n * w[0].islower()
            for (w, kind), n in parts.items():
                if key := letters(w):
                    held.setdefault(key, [0, 0, 0, 0, 0])[kind] += n
            words.clear()
            parts.clear()
            return pd.DataFrame([(k, *v) for k, v in held.items() if k], columns=["key", "n", "low", "given", "surname", "mail"])

        for pdf in batches:
            for t in pdf["text"]:
                if "@" in t:
                    for box in BOX.findall(t):
                        parts.update((w, 4) for w in PARTS.split(box))
                    t = re.sub(r"\S+@\S+", " ", t)
                words.update(WORD.findall(t))
                for full in NAMED.findall(t):
                    ends = re.split(",? ", full)
                    given, surname = (ends[-1], ends[0]) if "," in full else (ends[0], ends[-1])
                    parts.update([(given, 2), (surname, 3)])
            if len(words) > 300_000:
                yield rows()
        yield rows()

    sums = texts.select("text").mapInPandas(tally, "key string, n bigint, low bigint, given bigint, surname bigint, mail bigint").groupBy("key")
    return sums.agg(*[F.sum(c).alias(c) for c in ("n", "low", "given", "surname", "mail")]).where("n > 0")


def learn(texts: DataFrame) -> Model:
    """The lexicon counted over all texts, the potentials fitted on the bounded sample."""
    words = cut_lineage(counted(texts))
    total = F.col("given") + F.col("surname") + F.col("mail")
    names = words.where((F.char_length("key") >= 3) & (total >= SHARE * F.col("n")) & (F.col("low") <= LOWER * F.col("n")))
    rows = names.limit(NAMES + 1).collect()
    if len(rows) > NAMES:
        raise ValueError(f"more than {NAMES} names; raise NAMES if the executors can hold them")
    top = words.orderBy(F.desc("n"), "key").limit(WORDS).select("key", "n", "low").collect()
    lexicon = {r.key: (0, int(10 * r.low / r.n), k < SPELLED_OUT and r.n >= OFTEN) for k, r in enumerate(top)}
    for r in rows:
        least = max(1, 0.1 * max(r.given, r.surname))
        bits = (r.given >= least) + 2 * (r.surname >= least) + 4 * (r.mail > 0)
        lexicon[r.key] = (bits, int(10 * r.low / r.n), False)
    # rows are taken by hash, about POOL of them, equal ones once
    n = texts.count()
    pool = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < -(-1_000_000 * POOL // max(n, POOL))).select("text").distinct()
    busy, plain = [], []
    for r in sorted(pool.collect()):
        held = any(lexicon.get(letters(w), (0,))[0] for w in TOKEN.findall(r.text)) or LONG_NUMBER.search(r.text)
        (busy if held else plain).append(r.text)
    order = lambda t: zlib.crc32(t.encode("utf-8", "replace"))
    sample = sorted(busy, key=order)[:SAMPLE] + sorted(plain, key=order)[:PLAIN]
    return fit(sample, lexicon)


def redact(df: DataFrame, keys: list[str], text: str = "text", model: Model | None = None) -> DataFrame:
    """(keys..., text, entities): each row's text with typed placeholders, and the kinds found, sorted.

    Null texts stay null and empty ones empty, without kinds; repeated rows stay repeated; columns
    other than the keys are left out. Without a model one is learnt from the rows' own texts.
    """
    rows = df.select(*keys, F.col(text).alias("_text"))
    model = model or learn(rows.select(F.col("_text").alias("text")).where(F.col("text").isNotNull()))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spellings = Spellings(shared.value.lexicon)
        for batch in batches:
            for lo in range(0, len(batch), 4000):
                pdf = batch.iloc[lo : lo + 4000]
                plain = [t if isinstance(t, str) else "" for t in pdf["_text"]]
                once = list(dict.fromkeys(plain))
                of = dict(zip(once, decode(once, shared.value, spellings)))
                found = [of[t] for t in plain]
                texts = [replaced(t, f) if f else raw for t, f, raw in zip(plain, found, pdf["_text"])]
                yield pdf[keys].assign(text=texts, entities=[sorted({LABELS[lab] for _, _, lab in f}) for f in found])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(clean, f"{schema}, text string, entities array<string>")


def sources(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, rec_id, text) of chat messages and chunks, equal rows once."""
    a = messages.select(F.lit("chat_messages").alias("src"), F.col("id").alias("rec_id"), "text")
    return a.unionByName(chunks.select(F.lit("chunks").alias("src"), F.col("chunk_id").alias("rec_id"), "text")).distinct()
