"""Identifiers with a distinctive form, masked by type."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Forms of identifiers.
FORMS = {
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "IN_PAN": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "IN_GSTIN": r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9][A-Z][0-9A-Z]\b",
    "IN_IFSC": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "IN_VOTER": r"\b[A-Z]{3}[0-9]{7}\b",
    "IN_AADHAAR": r"\b[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}\b",
    "IN_PHONE": r"\b(?:\+?91[\-\s]?[6-9][0-9]{9}|[6-9][0-9]{4}[\-\s][0-9]{5})\b",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "US_PHONE": r"(?<!\w)(?:\+1[\-\s]?)?(?:\([0-9]{3}\)|[0-9]{3})[\-\s][0-9]{3}[\-\s][0-9]{4}(?!\w)",
    "CREDIT_CARD": r"\b[0-9](?:[\-\s]?[0-9]){12,18}\b",
}
PATTERNS = {k: re.compile(p) for k, p in FORMS.items()}


def _luhn(number: str) -> bool:
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def _verhoeff(number: str) -> bool:
    turn, step, check = list(range(10)), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), 0
    for c in reversed(number):
        x = turn[int(c)]
        if check < 5:
            check = (check + x) % 5 if x < 5 else 5 + (check + x) % 5
        else:
            check = 5 + (check - x) % 5 if x < 5 else (check - x) % 5
        turn = [step[t] for t in turn]
    return check == 0


CHECKS = {"IN_AADHAAR": _verhoeff, "CREDIT_CARD": _luhn}


def masked(text: str) -> tuple[str, list[str]]:
    """The text with [REDACTED:TYPE] for each identifier, and the sorted types. The earliest, then the
    longest match wins where forms overlap; numbers with check digits must pass."""
    hits = sorted(
        (m.start(), -m.end(), kind)
        for kind, form in PATTERNS.items()
        for m in form.finditer(text)
        if kind not in CHECKS or CHECKS[kind](re.sub(r"\D", "", m.group()))
    )
    out, at, kinds = [], 0, set()
    for start, end, kind in hits:
        if start >= at:
            out += (text[at:start], f"[REDACTED:{kind}]")
            kinds.add(kind)
            at = -end
    return "".join(out) + text[at:], sorted(kinds)


def kinds_union(masked_rows: DataFrame, by: str) -> DataFrame:
    """(by, kinds): the sorted distinct kinds over all rows of a group; there are as many kinds as forms at most."""
    return masked_rows.select(by, F.explode("kinds").alias("k")).groupBy(by).agg(F.array_sort(F.collect_set("k")).alias("kinds"))


def mask(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, kinds) of every row; null stays null. Only texts with a digit or an @ go to Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [masked(t) for t in pdf["text"]]
            yield pdf[["key"]].assign(text=[d[0] for d in done], kinds=[d[1] for d in done])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    clean = rows.where(~may).withColumn("kinds", F.array().cast("array<string>"))
    return rows.where(may).mapInPandas(run, f"key {kind}, text string, kinds array<string>").unionByName(clean).withColumnRenamed("key", key)
