import random

from pyspark.sql import functions as F

from ledgerloom.operators import chunking

ITEMS = "item_id bigint, source_doc_id string, seq int, role string, text string, level int, page int"


def packed(items, budget, overlap):
    """Sections packed in one go, as the operator must give them."""
    out, section, held = [], 0, []

    def flush():
        if held:
            out.append((section, "text", "\n\n".join(held)))
            held.clear()

    for role, text in items:
        if role in ("title", "subtitle"):
            flush()
            section += 1
        if role == "table" or len(text) > budget:
            flush()
            cut = [text] if len(text) <= budget else chunking.split_text(text, budget, overlap)
            out.extend((section, "table" if role == "table" else "text", c) for c in cut)
        else:
            if held and len("\n\n".join([*held, text])) > budget:
                flush()
            held.append(text)
    flush()
    return out


def test_long_sections_are_packed_as_in_one_go(spark, monkeypatch):
    monkeypatch.setattr(chunking, "STRETCH", 7)
    rng = random.Random(4)
    docs = {
        "mixed": [(rng.choices(["text", "title", "table"], [30, 1, 2])[0], "w" * rng.choice([1, 3, 8, 20, 45])) for _ in range(150)],
        "even": [("text", "abcde")] * 100,
        "tiny": [("text", "x")] * 90,
        "plain": [("text", "w" * rng.randrange(1, 30)) for _ in range(120)],
    }
    rows = [(n * 1000 + k, d, k, role, text, 0, None) for n, (d, items) in enumerate(docs.items()) for k, (role, text) in enumerate(items)]
    # sparse positions: stretches with a single item, over which a chunk goes on
    rows += [(9000 + k, "sparse", k * 7, "text", "ab", 0, None) for k in range(60)]
    docs["sparse"] = [("text", "ab")] * 60
    df = spark.createDataFrame(rows, ITEMS)
    got = {}
    for r in chunking.structure_chunks(df, 40, 5).orderBy("source_doc_id", "section", "part", "ordinal").collect():
        got.setdefault(r.source_doc_id, []).append((r.section, r.kind, r.chunk))
    for d, items in docs.items():
        assert got[d] == packed(items, 40, 5), d


def test_blocks_that_stand_whole(spark):
    rng = random.Random(2)
    words = ["net", "debt", "rose", "by", "a", "lot", "in", "may"]
    blocks, chunks = [], []
    for k in range(6):
        blocks += [(k, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for _ in range(25)]
        chunks += [(k, "  ".join(rng.choices(words, k=40)) + "\n") for _ in range(4)]
    chunks.append((0, blocks[0][1] + " " + blocks[1][1]))
    blocks += [(7, "alone here"), (8, " "), (8, None), (1, blocks[30][1])]
    own = lambda k: [f" {' '.join(c.split())} " for d, c in chunks if d == k]
    want = {}
    for k, b in blocks:
        if (b or "").strip():
            want.setdefault(k, []).append(any(f" {' '.join(b.split())} " in c for c in own(k)))
    b, c = spark.createDataFrame(blocks, "k int, b string"), spark.createDataFrame(chunks, "k int, c string")
    got = {r.k: round(r.share, 9) for r in chunking.whole_blocks(b, c, "k", "b", "c").collect()}
    assert got == {k: round(sum(v) / len(v), 9) for k, v in want.items()} and 0 < got[0] < 1
    assert chunking.whole_blocks(b.limit(0), c, "k", "b", "c").count() == 0


def test_coherence(spark):
    rows = [("d", 0, 4, [1.0, 0.0]), ("d", 1, 4, [0.0, 1.0]), ("d", 2, 4, [0.0, 1.0]), ("e", 0, 3, [1.0, 0.0]), ("f", 0, 9, [1.0, 0.0]), ("f", 1, 9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, ordinal int, size int, vector array<double>")
    got = {r.key: r.coherence for r in chunking.coherence(df, 8).collect()}
    # windows (0, 1) and (1, 2); one chunk alone, and chunks over the limit, give nothing
    assert set(got) == {"d"} and abs(got["d"] - (2**-0.5 * 2 + 2) / 4) < 1e-9


def test_neighbourhoods(spark):
    row = spark.sql("select array('a', 'b', 'c', 'd') as s, array() as none").select(chunking.neighbourhoods(F.col("s"), 1).alias("n"), chunking.neighbourhoods(F.col("s"), 2).alias("m"), F.size(chunking.neighbourhoods(F.col("none"))).alias("z")).first()
    assert row.n == ["a b", "a b c", "b c d", "c d"] and row.m[0] == "a b c" and row.m[3] == "b c d" and row.z == 0


def test_pinned(spark):
    rows = spark.createDataFrame([("d", "fixed", 0.1), ("d", "semantic", 0.9)], "k string, strategy string, score double")
    assert chunking.choose(rows, "k", pinned="fixed").first().strategy == "fixed"
    try:
        chunking.choose(rows, "k", pinned="other")
        raise AssertionError("an unknown strategy must be refused")
    except ValueError:
        pass
