import random

from pyspark.sql import functions as F
from test_retrieval import shuffled_rows

from ledgerloom.functions import text as tx
from ledgerloom.operators import chunking, gate


def by_frames(docs):
    """The same measures from the operators over rows of chunks and sentences."""
    blocks, out = docs.select("k", F.explode(tx.sentences(F.col("t"))).alias("block")), {}
    for name, chunks in (("fixed", chunking.recursive_chunks(docs, "k", "t")), ("semantic", chunking.semantic_chunks(docs, "k", "t"))):
        rows = chunks.select(F.col("k").alias("key"), F.col("ordinal").alias("chunk"), "chunk").toDF("key", "n", "text").withColumn("words", tx.tokens(F.col("text"))).withColumn("vector", chunking.bag(F.col("words"))).localCheckpoint()
        inner = rows.select("key", F.col("n").alias("chunk"), F.explode(tx.sentences(F.col("text"))).alias("s"))
        within = chunking.cohesion(inner.select("key", "chunk", chunking.bag(tx.tokens(F.col("s"))).alias("vector")), rows.select("key", F.col("n").alias("chunk"), "vector"))
        across = chunking.coherence(rows.select("key", F.col("n").alias("ordinal"), F.size("words").alias("size"), "vector"))
        size = rows.groupBy("key").agg(chunking.size_share(F.char_length("text")).alias("size"))
        whole = chunking.whole_blocks(blocks, rows.select(F.col("key").alias("k"), "text"), "k", "block", "text").toDF("key", "whole")
        for r in size.join(whole, "key", "left").join(within, "key", "left").join(across, "key", "left").collect():
            out[r.key, name] = tuple(None if x is None else round(x, 9) for x in (r.size, r.whole, r.cohesion, r.coherence))
    return out


def texts():
    dice = random.Random(5)
    words = ["net", "debt", "rose", "by", "7", "Plant", "été", "x" * 40, "a.b", "(new)", "K9", "\u212a", "数字"]
    gaps = [" "] * 30 + ["  ", "\t", "\n", "\n\n", ". ", ". ", "! ", "? (", '. "', "\r\n", "\u00a0", "\u2028", "\u0085 "]
    # as many letters as words of three, so that the long texts are cut in many ways
    out = ["".join(dice.choice(words).title() + dice.choice(gaps) for _ in range(n)) for n in [*range(1, 25), 120, 400, 1500]]
    out += ["", " \n", "One. Two.\nTwo.", "Same line.\n" * 60, "z" * 2000, "No words: été. Été. " * 2, "a \u2028", "ends \u2028.\nA b \u0085", "--\n--", "\u2003", None]
    return dict(enumerate(out))


def test_measures_in_the_row_are_those_of_the_frames(spark, monkeypatch):
    docs = spark.createDataFrame(list(texts().items()), "k bigint, t string").repartition(2).localCheckpoint()
    want = by_frames(docs.where("t is not null"))
    before = shuffled_rows(spark)
    got = {(r.k, r.strategy): tuple(None if x is None else round(x, 9) for x in (r["size"], r.whole, r.cohesion, r.coherence)) for r in gate.gate_metrics(docs, "k", "t").collect()}
    assert got == want and len(got) > 50
    # two rows a text move, none of its words, sentences or chunks
    assert shuffled_rows(spark) - before <= 2 * len(texts())


def test_hashes_are_those_of_spark(spark):
    words = ["", "a", "net", "debt", "x1234567", "y" * 31, "z" * 32, "0123456789" * 9]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()
    assert [r.h % 2**64 for r in rows] == [gate.xxhash64(w.encode()) for w in words]


def test_blocks_of_a_long_text_are_found_by_their_opening(monkeypatch):
    dice = random.Random(3)
    some = lambda n: " ".join(dice.choices(["net", "debt", "rose", "by", "a"], k=n))
    chunks, blocks = [some(60) for _ in range(9)], {some(dice.randrange(1, 9)) for _ in range(300)}
    short = gate.standing(blocks, chunks)
    monkeypatch.setattr(gate, "SEARCHED", 0)
    assert gate.standing(blocks, chunks) == short == {b for b in blocks if any(f" {b} " in f" {c} " for c in chunks)} and 0 < len(short) < len(blocks)


def test_texts_with_one_key_are_measured_together(spark):
    long = "Net debt rose by a lot. The plant was shut again. " * 9
    docs = spark.createDataFrame([("a", long), ("a", "One."), (None, long), ("b", None)], "k string, t string")
    got = {(r.k, r.strategy): r for r in gate.gate_metrics(docs, "k", "t").collect()}
    assert set(got) == {("a", "fixed"), ("a", "semantic"), (None, "fixed"), (None, "semantic")}
    assert got["a", "fixed"]["size"] == 0.5 and got[None, "fixed"]["size"] == 1.0 and got["a", "fixed"].cohesion == got[None, "fixed"].cohesion
