import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation, monitor, registry, retrieval


def test_bm25_against_brute_force(spark):
    docs = {1: "net income rose", 2: "income of the board", 3: "the the the", 4: "", 5: "income income net"}
    asked = {10: "net net income", 11: "absent"}
    df = spark.createDataFrame([*docs.items(), (6, None)], "id int, t string")
    out = {(r.query, r.key): r.score for r in retrieval.bm25(df, spark.createDataFrame(list(asked.items()), "query int, text string"), "id", "t").collect()}
    words = {k: t.split() for k, t in docs.items()} | {6: []}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df_ = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df_.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for k, ws in words.items():
        tf = Counter(ws)
        if set(ws) & {"net", "income"}:
            want[10, k] = round(sum((floor if idf[w] < 0 else idf[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in asked[10].split()), 6)
    assert out == want


def test_fusion(spark):
    arm = lambda keys: spark.createDataFrame([(1, k, n) for n, k in enumerate(keys, 1)], "query int, key string, rank int")
    out = retrieval.fuse([arm("abc"), arm("cd")]).orderBy("rank").collect()
    assert [r.key for r in out] == ["c", "a", "b", "d"] or [r.key for r in out] == ["c", "a", "d", "b"]
    assert retrieval.fuse([arm("abc").limit(0)]).count() == 0


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "vec_id bigint, embedding array<double>")
    q = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    out = retrieval.dense(df, q, k=5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for query in (0, 20, 40):
        want = [int(k) for k in np.argsort(-(u @ u[query]), kind="stable")[:5]]
        assert [r.key for r in sorted((r for r in out if r.query == query), key=lambda r: r.rank)] == want


def test_versions_access_filters(spark):
    rows = [("a", "k", 1, ["x"], "US"), ("b", "k", 2, None, "US"), ("c", None, 1, [], "IN"), ("d", " ", 1, ["y"], "US"), ("e", "k", 2, ["x", "y"], "IN")]
    df = spark.createDataFrame(rows, "id string, key string, rev int, tags array<string>, m string").withColumn("metadata", F.struct(F.col("m").alias("market")))
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(retrieval.latest_versions(df, F.col("key"), F.col("rev"))) == ["b", "c", "d", "e"]
    assert ids(df.where(retrieval.may_see(F.col("tags"), ["x"]))) == ["a", "b", "c", "e"] and ids(df.where(retrieval.may_see(F.col("tags"), []))) == ["b", "c"]
    assert ids(df.where(retrieval.matches({"market": "IN"}))) == ["c", "e"] and ids(retrieval.delete_where(df, {})) == ids(df) and ids(retrieval.delete_where(df, {"market": "US"})) == ["c", "e"]


def test_rollup(spark):
    rows = [(1, None, 1.0), (2, 1, 2.0), (3, 2, 4.0), (4, 3, 8.0), (5, 77, 16.0), (6, 6, 32.0)]
    out = {r.id: r.total for r in monitor.subtree_sums(spark.createDataFrame(rows, "id int, parent int, v double"), "id", "parent", "v").collect()}
    assert out == {1: 15.0, 2: 14.0, 3: 12.0, 4: 8.0, 5: 16.0, 6: 32.0}


def test_status(spark):
    rows = [("u", "a", "done"), ("u", "a", "failed"), ("u", "b", "skipped"), ("u", "b", "deferred"), ("u", "c", "odd")]
    out = {r.g: r.status for r in monitor.macro_status(spark.createDataFrame(rows, "u string, g string, status string"), "u", "g", "status").collect()}
    assert out == {"a": "failed", "b": "deferred", "c": "skipped"}


def test_evaluation(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["x"])], "e array<string>, f array<string>")
    assert [r.x for r in df.select(evaluation.recall(F.col("e"), F.col("f")).alias("x")).collect()] == [0.5, 1.0]
    board = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "name string, m double")
    assert [r.name for r in evaluation.leaderboard(board, "name", "m").orderBy("place").collect()] == ["a", "b", "c"]


def test_registry():
    r = registry.Registry()
    r.register("arm", "x")(lambda: 1)
    assert r.create("arm", "x") == 1 and r.matrix() == {"arm": ["x"]}
    for bad in (lambda: r.register("arm", "x")(int), lambda: r.create("arm", "y")):
        try:
            bad()
            raise AssertionError
        except (ValueError, KeyError):
            pass


def test_scope_fusion_and_versions(spark):
    from ledgerloom.operators import retrieval

    meta = "struct<collection_id: string, logical_key: string, source_revision: int>"
    rows = [
        ("a1", "net debt rose and debt fell", ("c1", "k", 1)), ("a2", "net debt rose again", ("c1", "k", 2)), ("a3", "net debt of the plant", ("c1", None, None)),
        ("b1", "net debt rose and debt fell", ("c2", "k", 9)), ("b1", "net debt rose and debt fell", ("c2", "k", 9)), (None, "net debt", ("c1", None, 1)), ("a4", None, ("c1", None, None)),
    ]
    chunks = spark.createDataFrame(rows, f"chunk_id string, text string, metadata {meta}")
    questions = spark.createDataFrame([(1, "net debt rose"), (2, "net debt rose"), (3, None)], "query bigint, text string")
    companies = spark.createDataFrame([(1, "c1")], "query bigint, collection_id string")
    out = retrieval.fused_search(chunks, questions, companies).orderBy("query", "rank").collect()
    assert [(r.query, r.key, r.rank) for r in out] == [(1, "a2", 1), (1, "a3", 2)]
    assert retrieval.fused_search(chunks.limit(0), questions, companies).count() == 0


def test_dense_keeps_the_best_over_batches(spark):
    import numpy as np

    from ledgerloom.operators import retrieval

    dice = np.random.default_rng(4)
    x = dice.integers(-2, 3, (300, 4)).astype(float)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 300, 20)], "query bigint, vector array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    got = {(r.query, r["rank"]): r.key for r in retrieval.dense(rows, asked, k=7).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q in range(0, 300, 20):
        score = np.round(unit @ unit[q], 6)
        want = sorted(range(300), key=lambda k: (-score[k], k))[:7]
        assert [got[q, r] for r in range(1, 8)] == want


def test_point_ids_and_judge_replies(spark):
    import uuid

    from pyspark.sql import functions as F

    from ledgerloom.functions import text as tx
    from ledgerloom.operators import answering

    names = ["a", "doc-1-0000", "é", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.p for r in df.select(tx.point_id(F.col("n")).alias("p")).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names]
    rows = [("It is 42 [1][2][1]", "42 and 7", "CONFIDENCE: 0.9\nUNSUPPORTED: 2"), ("It is 42 [1]", "7", "confidence: 0.8\nUnsupported: none"), ("No figure [3]", None, None), (None, None, "CONFIDENCE: 1")]
    out = answering.citations_verified(spark.createDataFrame(rows, "answer string, evidence string, reply string")).collect()
    assert [(r.confidence, r.citations) for r in out] == [(0.9, [1]), (0.0, [1]), (0.5, [3]), (1.0, [])]


def shuffled_rows(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_a_question_meets_only_the_chunks_of_its_company(spark):
    dice = np.random.default_rng(8)
    words = ["net", "debt", "rose", "of", "the", "plant", "again", "rare"]
    say = lambda least, most: " ".join(dice.choice(words, dice.integers(least, most)))
    texts = {f"k{n:03}": say(0, 12) for n in range(480)}
    home = {key: n % 120 for n, key in enumerate(texts)}
    asked = {q: f"of the debt of {say(1, 4)}" for q in range(240)}
    asked[241] = asked[1]  # alike, and with the words turned round
    asked[361] = " ".join(reversed(asked[1].split()))
    rows = [(key, t, (f"c{home[key]}", None, None)) for key, t in texts.items()]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, metadata struct<collection_id: string, logical_key: string, source_revision: int>")
    questions = spark.createDataFrame(list(asked.items()), "query bigint, text string")
    companies = spark.createDataFrame([(q, f"c{q % 120}") for q in asked], "query bigint, collection_id string")
    before = shuffled_rows(spark)
    got = {(r.query, r["rank"]): (r.key, r.score) for r in retrieval.fused_search(chunks, questions, companies, k=3).collect()}
    # 242 questions and 480 chunks make 116,160 pairs, 968 of them within a company
    assert shuffled_rows(spark) - before < 20_000

    split = {key: t.split() for key, t in texts.items()}
    mean = sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    idf = {w: math.log((len(split) - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for q, t in asked.items():
        arms = [{}, {}]
        for key, ws in split.items():
            tf = Counter(ws)
            if home[key] == q % 120 and set(ws) & set(t.split()):
                arms[0][key] = round(sum((floor if idf[w] < 0 else idf[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in t.split() if w in idf), 6)
                arms[1][key] = sum(tf[w] for w in t.split())
        fused = Counter()
        for arm in arms:
            for n, key in enumerate(sorted(arm, key=lambda x: (-arm[x], x))[:3], 1):
                fused[key] += 1 / (60 + n)
        for n, (key, score) in enumerate(sorted(((key, round(s, 9)) for key, s in fused.items()), key=lambda x: (-x[1], x[0]))[:3], 1):
            want[q, n] = (key, score)
    assert got == want


def test_the_cells_of_a_company_give_what_one_cell_gives(spark, monkeypatch):
    dice = np.random.default_rng(9)
    words = ["net", "debt", "rose", "of", "the", "plant", "again", "rare"]
    say = lambda least, most: " ".join(dice.choice(words, dice.integers(least, most)))
    rows = [(f"k{n:02}", say(0, 9), ("c1" if n % 4 else "c2", f"f{n % 7}" if n % 3 else None, int(dice.integers(0, 3)) if n % 5 else None)) for n in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, metadata struct<collection_id: string, logical_key: string, source_revision: int>")
    asked = [(q, say(1, 6)) for q in range(40)] + [(40, "absent")]
    questions = spark.createDataFrame(asked, "query bigint, text string")
    companies = spark.createDataFrame([(q, "c2" if q % 8 == 1 else "c1") for q, _ in asked], "query bigint, collection_id string")
    found = lambda: sorted(map(tuple, retrieval.fused_search(chunks, questions, companies, k=4).collect()))
    whole = found()
    monkeypatch.setattr(retrieval, "CHUNKS", 7)
    monkeypatch.setattr(retrieval, "BLOCK", 5)
    assert found() == whole and {q for q, *_ in whole} == set(range(40))
