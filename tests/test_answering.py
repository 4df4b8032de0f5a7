from ledgerloom.operators import answering as ans
from ledgerloom.operators import chat, chunking

DOCS = [(1, "Revenue was 10 million. More."), (2, "Net income was 5. Board met."), (3, None)]


def test_rerank_and_verify(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    asked = spark.createDataFrame([(7, "net income"), (8, "weather")], "query int, text string")
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "query int, key int, rank int")
    best = ans.rerank(hits, asked, docs, "doc_id", "text", keep=2).orderBy("rank").collect()
    assert [(r.key, r.rank) for r in best] == [(2, 1), (1, 2)]
    out = {r.query: r for r in ans.verified(asked, lambda left, n: ans.extract(left, hits, docs, "doc_id", "text", n)).collect()}
    assert (out[7].answer, out[7].cited, out[7].grounding, out[7].tries) == ("Revenue was 10 million. [1]", 1, 1.0, 1)
    assert out[8].answer == ans.ABSTAIN and out[8].cited is None
    kept = ans.kept_citations(spark.createDataFrame([(7, "x [2] y [9] [2]")], "query int, answer string"), hits).collect()
    assert [(r.query, r.key) for r in kept] == [(7, 2)]


def test_fallback(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted((r.k, r.v) for r in ans.first_answer([a, b], "k").collect()) == [(1, "a"), (2, "b")]


def test_embed_and_cohesion(spark):
    out = ans.embed(spark.createDataFrame(DOCS, "doc_id int, text string"), "doc_id", "text").collect()
    assert all(len(r.vector) == 64 for r in out) and sum(next(r for r in out if r.doc_id == 3).vector) == 0
    s = spark.createDataFrame([("d", 0, [1.0, 0.0]), ("d", 0, [0.0, 1.0]), ("d", 1, [1.0, 0.0])], "key string, chunk int, vector array<double>")
    c = spark.createDataFrame([("d", 0, [1.0, 1.0]), ("d", 1, [1.0, 0.0])], "key string, chunk int, vector array<double>")
    assert abs(chunking.cohesion(s, c).first().cohesion - 0.70710678) < 1e-6


def test_sessions(spark):
    s = spark.createDataFrame([("a", "t"), ("b", None)], "id string, title string")
    m = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, session_id string")
    assert {r.id: r.title for r in chat.renamed(s, "b", "new").collect()} == {"a": "t", "b": "new"}
    left, kept = chat.without_session(s, m, "a")
    assert [r.id for r in left.collect()] == ["b"] and sorted(r.id for r in kept.collect()) == ["2", "3"]
