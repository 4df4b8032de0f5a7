import random
from collections import Counter

from pyspark.sql import types as T

from ledgerloom.llm import leakage as leak

random.seed(11)
VOCAB = [f"w{k}" for k in range(400)]
ITEMS = [(k, " ".join(random.choice(VOCAB) for _ in range(40))) for k in range(30)]


def passage(item, a, n):
    return ITEMS[item][1].split()[a : a + n]


def filler(n):
    return [random.choice(["the", "of", "rose", "fell", "w1", "w2", "board", "met"]) for _ in range(n)]


def holds(a, b):
    return bool(leak.aligned(leak.np.array([a]), leak.np.array([b]))[0])


def test_alignment():
    a = list(range(40))
    assert holds(a, [99, *range(5, 17), 98])
    assert holds(a, [*range(5, 10), 99, *range(11, 15), 98, *range(16, 20)])
    assert holds(a, [*range(5, 10), *range(11, 18)]) and holds(a, [*range(5, 10), 99, *range(10, 17)])
    assert not holds(a, [99, *range(5, 13), 98, 97, 96]) and not holds(a, list(range(30, 5, -1)))


def local(a, b, least=12):
    """The alignment cell by cell, with plain lists."""
    score, start = [0] * (len(b) + 1), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        before, came = 0, i
        score[0], start[0] = 0, i + 1
        for j, y in enumerate(b):
            up, up_start = score[j + 1], start[j + 1]
            if x == y:
                s, at = before + 1, came if before else i
                if s >= least - 3 and i - at + 1 >= least:
                    return True
            else:
                s, at = max([(before - 1, -0, came), (up - 1, -1, up_start), (score[j] - 1, -2, start[j])], key=lambda o: (o[0], o[1]))[::2]
                if s <= 0:
                    s, at = 0, i + 1
            before, came = up, up_start
            score[j + 1], start[j + 1] = s, at
    return False


def test_alignment_and_subsequence_against_brute_force():
    dice = random.Random(2)
    a = [[dice.randrange(9) for _ in range(30)] for _ in range(300)]
    b = []
    for row in a:
        own = row[dice.randrange(12) :][: dice.randrange(9, 20)]
        for _ in range(dice.randrange(5)):
            at = dice.randrange(len(own))
            own[at : at + dice.randrange(2)] = [dice.randrange(9)] * dice.randrange(2)
        b.append(([dice.randrange(20, 40) for _ in range(5)] + own + [dice.randrange(20, 40) for _ in range(30)])[:30])
    got = leak.aligned(leak.np.array(a), leak.np.array(b))
    assert list(got) == [local(x, y) for x, y in zip(a, b)] and 0 < got.sum() < 300

    def subsequence(x, y):
        row = [0] * (len(y) + 1)
        for p in x:
            row = [0] + [max(row[j] + 1 if p == q else 0, row[j + 1]) for j, q in enumerate(y)]
            for j in range(len(y)):
                row[j + 1] = max(row[j + 1], row[j])
        return row[-1]

    assert list(leak.common(leak.np.array(a), leak.np.array(b))) == [subsequence(x, y) for x, y in zip(a, b)]


def pairs_shared(item, words):
    own = ITEMS[item][1].split()
    return len(set(zip(own, own[1:])) & set(zip(words, words[1:])))


def test_paraphrases_without_shared_pairs(spark):
    """A word put in after each word of the item: no two neighbours of the item stay neighbours."""
    docs, truth = [], set()
    for d in range(60):
        words = filler(60)
        if d % 3 == 0:
            item = d % 30
            put = [w for p in passage(item, 8, 20) for w in (p, random.choice(["surely", "indeed", "perhaps", "also", "then"]))]
            words[20:20] = put
            assert pairs_shared(item, put) < 6
            truth.add((d, item))
        elif d % 3 == 1:
            words[20:20] = [w for p in passage(d % 30, 8, 8) for w in (p, "indeed")]
        docs.append((d, " ".join(words)))
    held = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {(r.doc_id, r.item) for r in leak.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), held).collect()}
    assert got == truth


def test_figures_of_the_item_must_stand_by(spark):
    item = [f"v{k}" for k in range(7)] + ["1189", "4021"] + [f"v{k}" for k in range(7, 18)]
    put = lambda ws: " ".join(w for p in ws for w in (p, "indeed"))
    wrong = [w if not w.isdigit() else "77" for w in item]
    docs = [(1, put(item)), (2, put(wrong)), (3, " ".join(wrong))]
    held = spark.createDataFrame([*ITEMS, (90, " ".join(item))], "item_id bigint, text string")
    got = {(r.doc_id, r.item) for r in leak.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), held).collect()}
    assert got == {(1, 90), (3, 90)}


def test_long_tags_part_no_passage(spark):
    words = passage(3, 0, 14)
    tag = '<a class="' + "x " * 200 + '" href="https://example.org/' + "p" * 100 + '">'
    assert len(tag) > 300 and leak.tokens(f"one {tag} two &amp; three < four") == [b"one", b"two", b"three", b"four"]
    held = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join([*words[:7], tag, *words[7:]]))], "doc_id bigint, text string")
    assert [(r.doc_id, r.item) for r in leak.find_leaks(docs, held).collect()] == [(1, 3)]


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leak, "ITEMS", 7)
    monkeypatch.setattr(leak, "AT_ONCE", 5)
    docs = spark.createDataFrame([(k, " ".join(passage(k, 4, 15))) for k in range(30)], "doc_id bigint, text string")
    held = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert {(r.doc_id, r.item) for r in leak.find_leaks(docs, held).collect()} == {(k, k) for k in range(30)}


def test_planted_passages(spark):
    docs, truth = [], set()
    for d in range(200):
        words = filler(60)
        if d % 4 == 0:
            item, a, n = d % 30, random.randrange(0, 20), random.choice([14, 18, 25])
            p = passage(item, a, n)
            if d % 8 == 0:
                p[n // 2] = "changed"
            at = random.randrange(0, 50)
            words[at:at] = [w.upper() if d % 3 == 0 else w for w in p]
            truth.add((d, item))
        elif d % 4 == 1:
            words[10:10] = passage(d % 30, 3, 7)
        docs.append((d, (", " if d % 5 == 0 else "  \n" if d % 5 == 1 else " ").join(words), "clash"))
    docs += [docs[0], (500, None, ""), (501, "", ""), (502, "the board " * 20000, ""), (None, ITEMS[0][1], "")]
    held = spark.createDataFrame([*ITEMS, ITEMS[0], (77, None), (78, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item) for r in leak.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item string"), held).collect()}
    assert got == truth


class Here:
    """A table whose mapInPandas gives the function itself, so that a pass runs in this process."""

    sparkSession = sparkContext = property(lambda self: self)
    schema = {"key": type("Field", (), {"dataType": T.LongType()})}

    def broadcast(self, value):
        return type("Shared", (), {"value": value})

    def mapInPandas(self, function, schema):
        return function


def test_one_alignment_settles_a_pair(monkeypatch):
    """Of the many windows in which a pair meets only the nearest is aligned, and none with too few words in common."""
    calls, held = [], leak.Items(ITEMS)
    aligned = leak.aligned
    monkeypatch.setattr(leak, "aligned", lambda a, b: calls.append(len(b)) or aligned(a, b))
    number = lambda ws: leak.np.array([held.vocabulary.get(w.encode(), -1) for w in ws], leak.np.int32)
    whole = [number(["?"] * 9 + passage(k, 0, 40) + ["?"] * 9) for k in range(30)]
    short = [number(["?"] * 9 + passage(k, 8, 8) + ["?"] * 9) for k in range(30)]
    terms = len(held.vocabulary)
    run = leak.candidates_checked(Here(), Here().broadcast(held), leak.np.ones(terms, leak.np.float32), leak.np.eye(terms, dtype=leak.np.float32))
    rows = leak.pd.DataFrame({"key": range(60), "words": whole + short})
    got = leak.pd.concat(list(run(iter([rows]))))
    assert sorted(zip(got["key"], got["item"])) == [(k, k) for k in range(30)]
    assert sum(calls) == 30
    windows = leak.unit(leak.times(*leak.sparse(held.alone, leak.np.ones(terms, leak.np.float32)), leak.np.eye(terms)))
    for key, cosine in zip(got["key"], got["cosine"]):
        texts = [whole[key][s : s + 20] for s in leak.starts(58)]
        own = leak.unit(leak.np.array([[(t == w).sum() > 0 for w in range(terms)] for t in texts]) * 1.0)
        assert abs(cosine - (own @ windows.T)[:, held.window_item == key].max()) < 0.1


def test_pairs_keep_their_best_that_holds():
    """A nearer candidate that doesn't hold neither hides nor lifts one that does."""
    held = leak.Items(ITEMS)
    full, none = held.around[0], leak.np.where(leak.np.arange(60) < 0, held.around[0], -1)
    cases = [(5, 0.9, none), (5, 0.7, full), (5, 0.8, full), (2, 0.6, none), (3, 0.95, full), (3, 0.56, full), (2, 0.99, none)]
    pair, near, around = (leak.np.array(x) for x in zip(*cases))
    good = leak.best_held(held, pair, near, leak.np.zeros(7, int), around)
    assert sorted(zip(pair[good], near[good])) == [(3, 0.95), (5, 0.8)]


def test_stretches_of_many_texts_as_of_each_alone():
    dice = random.Random(5)
    texts = [leak.np.array([dice.choice([-1, -1, 3] if k // 40 % 3 else [1, 2, -1]) for k in range(dice.choice([0, 1, 8, 9, 20, 21, 28, 29, 400]))], leak.np.int32) for _ in range(300)]
    want = []
    for k, words in enumerate(texts):
        good = [s for s in leak.starts(len(words)) if (words[s : s + 20] >= 0).sum() >= leak.SHARED]
        for n, s in enumerate(good):
            if n and s - good[n - 1] <= 20:
                want[-1] = (k, want[-1][1], min(s + 20, len(words)))
            else:
                want.append((k, s, min(s + 20, len(words))))
    sizes = leak.np.array([len(t) for t in texts])
    text, lo, hi = leak.able(leak.np.concatenate(texts), sizes)
    before = (leak.np.cumsum(sizes) - sizes)[text]
    assert list(zip(text, lo - before, hi - before)) == want and len(want) > 100
    text, windows = leak.windows_of(texts, 20, 60)
    assert [list(w) for w in windows] == [[int(t[p]) if 0 <= p < len(t) else -1 for p in range(s - 20, s + 40)] for t in texts for s in leak.starts(len(t))]
    assert list(text) == [k for k, t in enumerate(texts) for _ in leak.starts(len(t))]
    row, term, count = leak.terms_of(windows)
    assert list(zip(row, term, count)) == [(k, w, n) for k, x in enumerate(windows) for w, n in sorted(Counter(x[x >= 0].tolist()).items())]


def test_characters_that_part_words_or_have_no_width():
    assert leak.tokens("Na\u00efve\u2014mi\u00adni\u200bmum \u201cR\u00e9sum\u00e9\u201d \u00e2 \u00e2\u20ac\u2019s caf\u00e9\u3000\u5e74 \U0001f600\ufeffx") == [
        w.encode() for w in ("na\u00efve", "minimum", "r\u00e9sum\u00e9", "s", "caf\u00e9", "\u5e74", "\U0001f600x")]


def test_lone_letters_are_dropped_before_the_search(spark):
    """Letters that garbled punctuation leaves between words stand for nothing, so the passage stays whole."""
    words = [w for p in passage(4, 2, 14) for w in (p, "\u00e2", "\u00e3")]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(passage(5, 2, 8)))], "doc_id bigint, text string")
    held = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert [(r.doc_id, r.item) for r in leak.find_leaks(docs, held).collect()] == [(1, 4)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    held = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert leak.find_leaks(docs, held).count() == 0 and leak.find_leaks(docs, held.limit(0)).count() == 0
