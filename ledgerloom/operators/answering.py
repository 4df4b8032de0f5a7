"""Batched answering: embedding, reranking, generation and verification with models passed in.

A model is a function over a list of texts; it runs inside tasks, once per Arrow batch. The
functions here that stand in for models are deterministic and need nothing installed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Attempts of the verified loop, and the grounding an answer needs.
ATTEMPTS, BAR = 2, 0.6
ABSTAIN = "The provided sources do not contain the answer."


def hashed(texts: list[str], width: int = 64) -> list[list[float]]:
    """Bags of words folded into width places by a fixed polynomial; a stand-in for an embedder."""
    out = []
    for t in texts:
        v = [0.0] * width
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            v[reduce(lambda h, c: (h * 131 + ord(c)) % 1_000_003, w, 7) % width] += 1.0
        out.append(v)
    return out


def overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of a question's words that a text has; a stand-in for a cross-encoder."""
    out = []
    for q, t in pairs:
        want = set(re.findall("[a-z0-9]+", (q or "").lower()))
        out.append(len(want & set(re.findall("[a-z0-9]+", (t or "").lower()))) / len(want) if want else 0.0)
    return out


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]] = hashed) -> DataFrame:
    """(key, vector) in the order of the batches; a null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"key": pdf["key"], "vector": model(list(pdf["text"]))})

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, vector array<double>").withColumnRenamed("key", key)


def rerank(ranked: DataFrame, queries: DataFrame, texts: DataFrame, key: str, text: str, keep: int = 5, model: Callable = overlap) -> DataFrame:
    """(query, key, score, rank): candidates scored by the model, through a sigmoid, the best kept; ties by the old rank.

    ranked: (query, key, rank); queries: (query, text).
    """
    rows = ranked.select("query", "key", F.col("rank").alias("old")).join(queries.select("query", F.col("text").alias("question")), "query")
    rows = rows.join(texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("passage")), "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = model(list(zip(pdf["question"], pdf["passage"])))
            yield pdf[["query", "key", "old"]].assign(score=[round(1 / (1 + math.exp(-s)), 9) for s in scores])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    scored = rows.select("query", "key", "old", "question", "passage").mapInPandas(run, f"query {kinds['query']}, key {kinds['key']}, old int, score double")
    from .retrieval import top_k

    return top_k(scored.withColumn("order", F.struct("score", -F.col("old"))), keep, "query", "key", "order").select("query", "key", "score", "rank")


def extract(questions: DataFrame, ranked: DataFrame, texts: DataFrame, key: str, text: str, place: int) -> DataFrame:
    """(query, answer, evidence, cited): the first sentence of the hit at a place, marked with its number."""
    hit = ranked.where(F.col("rank") == place).join(texts.select(F.col(key).alias("key"), F.col(text).alias("evidence")), "key")
    first = F.get(tx.sentences(F.col("evidence")), F.lit(0))
    rows = hit.withColumn("first", first).where(F.col("first").isNotNull())
    return questions.select("query").join(rows.select("query", F.concat("first", F.lit(f" [{place}]")).alias("answer"), "evidence", F.col("key").alias("cited")), "query")


def verified(questions: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], attempts: int = ATTEMPTS, bar: float = BAR) -> DataFrame:
    """(query, answer, cited, grounding, tries): the best attempt per question, or an abstention.

    An attempt is checked against its own evidence; only questions that missed the bar go on to the next
    one. Questions without any attempt, or whose best one misses the bar, abstain with grounding 0.
    """
    left, done = questions.select("query"), []
    for n in range(1, attempts + 1):
        made = attempt(left, n).withColumn("grounding", F.round(tx.grounding(F.col("answer"), F.col("evidence")), 6)).withColumn("tries", F.lit(n))
        done.append(made.select("query", "answer", "cited", "grounding", "tries"))
        passed = made.where(F.col("grounding") >= bar).select("query")
        left = left.join(passed, "query", "left_anti")
    every = reduce(DataFrame.unionByName, done)
    best = every.groupBy("query").agg(F.max_by(F.struct("answer", "cited", "grounding", "tries"), F.struct("grounding", -F.col("tries"))).alias("b"))
    out = questions.select("query").join(best, "query", "left")
    good = F.coalesce(F.col("b.grounding") >= bar, F.lit(False))
    return out.select(
        "query", F.when(good, F.col("b.answer")).otherwise(ABSTAIN).alias("answer"), F.when(good, F.col("b.cited")).alias("cited"), F.when(good, F.col("b.grounding")).otherwise(0.0).alias("grounding"), F.coalesce("b.tries", F.lit(0)).alias("tries")
    )


def first_answer(stages: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first stage that has any for a key."""
    every = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(n)) for n, s in enumerate(stages)])
    first = every.groupBy(key).agg(F.min("stage").alias("stage"))
    return every.join(first, [key, "stage"], "left_semi")


def kept_citations(answers: DataFrame, ranked: DataFrame, answer: str = "answer") -> DataFrame:
    """(query, key): sources that an answer cites and that are among its ranked hits, once each."""
    cited = answers.select("query", F.explode(F.array_distinct(tx.citation_markers(F.col(answer)))).alias("rank"))
    return cited.join(ranked.select("query", "rank", "key"), ["query", "rank"]).select("query", "key").distinct()


# How a judge's reply names its confidence and the sources that do not support their claim.
CONFIDENCE, UNSUPPORTED, UNSURE = r"(?i)CONFIDENCE:\s*([01](?:\.\d+)?|\.\d+)", r"(?i)UNSUPPORTED:\s*([^\n]*)", 0.5


def judged(reply: Column) -> tuple[Column, Column]:
    """(confidence, numbers of unsupported sources) of a judge's reply; a reply without a number is unsure."""
    number = F.nullif(F.regexp_extract(reply, CONFIDENCE, 1), F.lit("")).cast("double")
    flagged = F.regexp_extract_all(F.regexp_extract(reply, UNSUPPORTED, 1), F.lit(r"(\d+)"), 1)
    return F.coalesce(number, F.lit(UNSURE)), F.transform(F.coalesce(flagged, F.array().cast("array<string>")), lambda x: x.cast("int"))


def citations_verified(answers: DataFrame, answer: str = "answer", evidence: str = "evidence", reply: str = "reply") -> DataFrame:
    """Adds confidence (the smaller of the figures' grounding and the judge's) and citations (marks of the answer that
    the judge does not flag, each once, in order)."""
    confidence, flagged = judged(F.coalesce(reply, F.lit("")))
    ground = tx.grounding(F.coalesce(answer, F.lit("")), F.coalesce(evidence, F.lit("")))
    kept = F.array_except(F.array_distinct(tx.citation_markers(F.coalesce(answer, F.lit("")))), flagged)
    return answers.withColumns({"confidence": F.round(F.least(ground, confidence), 6), "citations": kept})
