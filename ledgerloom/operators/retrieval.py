"""Retrieval over whole corpora: lexical, sparse and dense search, fusion, versions, access."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import written

#: Queries that are broadcast at a time.
BLOCK = 4096
#: Chunks of a company that are searched at a time.
CHUNKS = 512
#: Words as in functions.text.tokens, of text in lower case.
WORD = re.compile("[a-z0-9]+")


def matches(filters: dict[str, object], prefix: str = "metadata.") -> Column:
    """AND of equalities, each value compared in its column's type; no filter lets everything through."""
    return reduce(lambda a, b: a & b, [F.col(prefix + k) == F.lit(v) for k, v in filters.items()], F.lit(True))


def may_see(tags: Column, caller: list[str]) -> Column:
    """Untagged rows, and rows that share a tag with the caller; a null list of tags is untagged."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    return (F.size(own) == 0) | F.arrays_overlap(own, F.array(*[F.lit(c) for c in caller]).cast("array<string>"))


def delete_where(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that do not meet all filters; an empty filter deletes nothing."""
    return rows.where(~F.coalesce(matches(filters), F.lit(False))) if filters else rows


def latest_versions(chunks: DataFrame, key: Column, version: Column) -> DataFrame:
    """Chunks of the latest version of their logical key; chunks without a key pass.

    The maximum per key is an aggregate joined back, so that a hot key is never sorted in one task.
    """
    rows = chunks.withColumns({"_key": F.nullif(F.trim(key), F.lit("")), "_version": version})
    top = rows.where("_key is not null").groupBy("_key").agg(F.max("_version").alias("_top"))
    joined = rows.join(top, "_key", "left")
    return joined.where(F.col("_key").isNull() | F.col("_version").eqNullSafe(F.col("_top"))).select(*chunks.columns)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length) over whole texts."""
    words = docs.select(F.col(key).alias("key"), tx.tokens(F.col(text)).alias("w"))
    return words.select("key", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("key", "length", "term").agg(F.count("*").alias("tf"))


def top_k(scored: DataFrame, k: int, query: str = "query", item: str = "key", score: str = "score") -> DataFrame:
    """The k best per query, ties by item; Spark keeps only k rows per query and task before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query, term, times) of the queries' own words. queries: (query, text)."""
    return queries.select("query", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))


def inverse_frequencies(words: DataFrame, epsilon: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(term, idf) of all terms, and one row (n, mean): texts and words a text. words: one array w for each text.

    A negative idf becomes epsilon times the mean idf.
    """
    totals = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))  # one row on the right
    idf = df.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean_idf = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.crossJoin(F.broadcast(mean_idf)).withColumn("idf", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")))
    return idf.select("term", "idf"), totals


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int = 20, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query, key, score, rank): Okapi scores of documents that share a term with the query.

    Statistics cover all documents (an empty text is a document of length 0). A negative idf becomes
    epsilon times the mean idf; a term that a query repeats counts again. queries: (query, text).
    """
    idf, totals = inverse_frequencies(docs.select(tx.tokens(F.col(text)).alias("w")), epsilon)
    mean = totals.first()["mean"] or 1.0
    weights = asked_terms(queries).join(idf, "term").select("query", "term", (F.col("times") * F.col("idf")).alias("weight"))
    return ranked(docs, weights, key, text, k, lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))


def sparse(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int = 20) -> DataFrame:
    """(query, key, score, rank): dot products of term counts over shared terms."""
    weights = asked_terms(queries).select("query", "term", F.col("times").cast("double").alias("weight"))
    return ranked(docs, weights, key, text, k, lambda tf, length: tf)


def asked_alike(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(asked, collection_id, terms, queries): questions about one company in the same words, under one number. terms: a
    word as often as it is asked; companies: (query, collection_id), at most one row each."""
    words = questions.select("query", F.array_sort(tx.tokens(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    alike = words.join(companies.where("collection_id is not null"), "query").groupBy("collection_id", "terms").agg(F.collect_list("query").alias("queries"))
    return written(alike.select(F.monotonically_increasing_id().alias("asked"), "collection_id", "terms", "queries"))


def fused_search(chunks: DataFrame, questions: DataFrame, companies: DataFrame, key: str = "chunk_id", text: str = "text", k: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score, rank): lexical and sparse arms over the chunks of the company each question names,
    fused by reciprocal ranks, with superseded versions dropped. Questions that name no company have no scope
    and are searched nowhere here.

    A question meets the chunks of its company alone, and like questions about a company are searched once. Questions
    and chunks of a company meet in cells of bounded size, which send on what is among the best k of an arm there. The
    words of the chunks are written to the shared folder first, as statistics (over all chunks) and the search read them.
    """
    row = F.struct(F.col(text).alias("text"), F.col("metadata.logical_key").alias("logical_key"), F.col("metadata.source_revision").alias("revision"))
    once = chunks.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(row).alias("c"), F.collect_set("metadata.collection_id").alias("of"))
    once = written(once.select("key", tx.tokens(F.col("c.text")).alias("w"), F.nullif(F.trim("c.logical_key"), F.lit("")).alias("logical_key"), "c.revision", "of"))
    alike = asked_alike(questions, companies)
    idf, totals = inverse_frequencies(once)
    mean = totals.first()["mean"] or 1.0
    said = once.where(F.size("w") > 0).select("key", F.array_join("w", " ").alias("words"), "logical_key", "revision", F.explode("of").alias("collection_id"))
    # a company has so many parts of chunks and of questions, and a cell for each two of them
    parts = lambda rows, most, name: rows.groupBy("collection_id").agg(F.ceil(F.count("*") / most).alias(name))
    sizes = parts(said, CHUNKS, "down").join(parts(alike, BLOCK, "across"), "collection_id")
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    docs = said.join(sizes, "collection_id").select("collection_id", own("key", "down").alias("part"), each("across").alias("block"), "key", "words", "logical_key", "revision")
    asked = alike.join(sizes, "collection_id").select("collection_id", each("down").alias("part"), own("asked", "across").alias("block"), "asked", "terms")
    asked = asked.withColumn("term", F.explode("terms")).drop("terms").join(idf, "term")

    def search(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("key")  # ties go to the smaller key
        words = [w.split(" ") for w in docs["words"]]
        there = {w for ws in words for w in ws}
        asked = asked[asked["term"].isin(there)]
        term, terms = pd.factorize(asked["term"])
        query, names = pd.factorize(asked["asked"])
        number = {t: n for n, t in enumerate(terms)}
        weight = np.zeros(len(terms))
        weight[term] = asked["idf"].to_numpy()
        count = np.zeros((len(words), len(terms)))
        for n, ws in enumerate(words):
            np.add.at(count[n], [number[w] for w in ws if w in number], 1)
        length = np.array([len(w) for w in words], np.float64)[:, None]
        share = weight * count * (k1 + 1) / (count + k1 * (1 - b + b * length / mean))
        out = []
        for lo in range(0, max(len(names), 1), 256):  # what is multiplied at a time
            some = (query >= lo) & (query < lo + 256)
            times = np.zeros((len(terms), len(names[lo : lo + 256])))
            np.add.at(times, (term[some], query[some] - lo), 1)
            sparse = (count @ times).T
            lexical = np.round((share @ times).T, 6)
            best = np.zeros(sparse.shape, bool)
            for arm in (lexical, sparse):
                np.put_along_axis(best, np.argsort(np.where(sparse > 0, -arm, np.inf), axis=1, kind="stable")[:, :k], True, 1)
            q, d = np.nonzero(best & (sparse > 0))
            hits = docs[["key", "logical_key", "revision"]].iloc[d].reset_index(drop=True)
            out.append(hits.assign(asked=names[lo + q], lexical=lexical[q, d], sparse=sparse[q, d]))
        return pd.concat(out)

    cell = ("collection_id", "part", "block")
    kinds = f"asked bigint, lexical double, sparse double, key {said.schema['key'].dataType.simpleString()}, logical_key string, revision {said.schema['revision'].dataType.simpleString()}"
    hits = docs.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(search, kinds)
    place = lambda arm: F.row_number().over(Window.partitionBy("asked").orderBy(F.col(arm).desc(), "key"))
    of_arm = lambda arm: F.when(F.col(arm) <= k, 1.0 / (60 + F.col(arm))).otherwise(0.0)
    rows = hits.withColumn("lexical", place("lexical")).withColumn("sparse", place("sparse")).where((F.col("lexical") <= k) | (F.col("sparse") <= k))
    rows = rows.select("asked", "key", "logical_key", "revision", F.round(of_arm("lexical") + of_arm("sparse"), 9).alias("score"))
    rows = rows.withColumn("top", F.max("revision").over(Window.partitionBy("asked", "logical_key")))
    best = top_k(rows.where(F.col("logical_key").isNull() | F.col("revision").eqNullSafe(F.col("top"))).select("asked", "key", "score"), k, "asked")
    return alike.select("asked", F.explode("queries").alias("query")).join(best, "asked").select("query", "key", "score", "rank")


class Best:
    """The best k of a task so far for each of many queries, carried over its batches; ties go to the smaller key."""

    def __init__(self, k: int):
        self.k, self.keys, self.score = k, None, None

    def add(self, score: np.ndarray, keys: np.ndarray) -> None:
        """score: a row per query, a column per key; minus infinity is no hit."""
        keys = np.broadcast_to(keys, score.shape)
        if score.shape[1] > self.k:  # those at or above the k-th best; ties are settled by the key below
            level = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            wide = max(int(((score >= level) & (score > -np.inf)).sum(axis=1).max()), 1)
            order = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            score, keys = np.take_along_axis(score, order, 1), np.take_along_axis(keys, order, 1)
        if self.score is not None:
            score, keys = np.concatenate([self.score, score], axis=1), np.concatenate([self.keys, keys], axis=1)
        order = np.lexsort((keys, -score), axis=1)[:, : self.k]
        self.score, self.keys = np.take_along_axis(score, order, 1), np.take_along_axis(keys, order, 1)

    def rows(self, names: np.ndarray) -> pd.DataFrame:
        if self.score is None:
            return pd.DataFrame({"query": names[:0], "key": [], "score": []})
        hit = self.score.ravel() > -np.inf
        return pd.DataFrame({"query": np.repeat(names, self.score.shape[1])[hit], "key": self.keys.ravel()[hit], "score": self.score.ravel()[hit]})


def ranked(docs: DataFrame, weights: DataFrame, key: str, text: str, k: int, share: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query, key, score, rank): the k documents with the largest sums over the words they share with a query of its
    weight times share(occurrences, words of the document).

    The queries' weights (query, term, weight) go out in blocks of bounded size; documents are scored where they
    lie and each task sends on its best k per query alone. Documents without a key are no hits.
    """
    blocks = max(1, -(-weights.select("query").distinct().count() // BLOCK))
    kinds = f"query {weights.schema['query'].dataType.simpleString()}, key {docs.schema[key].dataType.simpleString()}, score double"
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text"))
    out = None
    for block in range(blocks):
        part = weights.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toPandas().sort_values(["query", "term"])
        if not len(part):
            continue
        names = part["query"].unique()
        groups = []
        for lo in range(0, len(names), 256):  # what is multiplied at a time
            some = part[part["query"].isin(names[lo : lo + 256])]
            term, terms = pd.factorize(some["term"])
            query = pd.Index(names[lo : lo + 256]).get_indexer(some["query"])
            table = np.zeros((len(terms), len(names[lo : lo + 256])))
            np.add.at(table, (term, query), some["weight"].to_numpy())
            asks = np.zeros(table.shape)
            asks[term, query] = 1  # a weight may be 0
            groups.append((names[lo : lo + 256], {t: n for n, t in enumerate(terms)}, table, asks))
        shared = docs.sparkSession.sparkContext.broadcast(groups)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            groups = shared.value
            best = [Best(k) for _ in groups]
            for batch in batches:
                for lo in range(0, len(batch), 512):
                    pdf = batch.iloc[lo : lo + 512]
                    words = [WORD.findall(t) for t in pdf["text"]]
                    length = np.array([len(w) for w in words], np.float64)
                    keys = pdf["key"].to_numpy()
                    for (_, number, table, asks), top in zip(groups, best):
                        count = np.zeros((len(words), len(number)))
                        for n, ws in enumerate(words):
                            hits = [number[w] for w in ws if w in number]
                            np.add.at(count[n], hits, 1)
                        score = share(count, length[:, None]) @ table
                        score[(count > 0).astype(np.float64) @ asks == 0] = -np.inf
                        top.add(np.round(score, 6).T, keys)
            for (names, *_), top in zip(groups, best):
                yield top.rows(names)

        hits = rows.mapInPandas(search, kinds)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"{kinds}, rank int")
    return top_k(out, k)


def dense(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query, key, score, rank): exact cosine search of a query set against all rows.

    Queries go out in blocks of bounded size; each task keeps the best k per query of its rows, and
    only those are shuffled. Null and zero vectors score 0 as queries and are no hits as rows.
    queries: (query, vector).
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col("vector").isNotNull()).select("query", "vector")
    n = asked.count()
    blocks = max(1, -(-n // BLOCK))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toPandas()
        if not len(part):
            continue
        q = np.stack([np.asarray(v, np.float64) for v in part["vector"]])
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((part["query"].to_numpy(), q))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            best = Best(k)
            for pdf in batches:
                x = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]]) if len(pdf) else np.zeros((0, q.shape[1]))
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                score = np.round(q @ x.T, 6)
                keys = pdf["key"].to_numpy()
                if len(pdf):
                    best.add(score, keys)
            yield best.rows(names)

        kinds = f"query {asked.schema['query'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, score double"
        hits = rows.mapInPandas(search, kinds)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "query bigint, key bigint, score double, rank int")
    return top_k(out, k)


def fuse(arms: list[DataFrame], k: int = 20, constant: int = 60) -> DataFrame:
    """(query, key, score, rank): reciprocal rank fusion of ranked arms (query, key, rank)."""
    every = reduce(DataFrame.unionByName, [a.select("query", "key", "rank") for a in arms])
    return top_k(every.groupBy("query", "key").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score")), k)


def numbered_sources(ranked: DataFrame, texts: DataFrame, key: str, text: str, keep: int = 5) -> DataFrame:
    """(query, prompt): the kept hits of each query as numbered snippets of 240 characters."""
    rows = ranked.where(F.col("rank") <= keep).join(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), tx.shortened(F.coalesce("text", F.lit("")), 240))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("query").agg(F.array_join(lines, "\n").alias("prompt"))
