import datetime as dt
import random
from itertools import pairwise

from ledgerloom.llm import conversations as conv
from ledgerloom.llm.components import connected_components

M = "id string, session_id string, role string, text string, meta string, created_at timestamp_ntz, conversation string, side string"
S = "id string, user_id string, conversation string"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def brute(messages, sessions):
    key = lambda s: (s or "").strip().lower() or None
    own = {}
    for s in sorted(x[0] for x in sessions if x[0]):
        own.setdefault(key(s), s)
    by_id = {}
    for m in messages:
        if m[0]:
            by_id[m[0]] = m
    groups = {}
    for m in by_id.values():
        groups.setdefault(key(m[1]), []).append(m)
    out = []
    for k, ms in groups.items():
        if k is None or k not in own:
            continue
        sides = [("user" if (m[2] or "").strip().lower() in conv.USER else "assistant" if (m[2] or "").strip().lower() in conv.ASSISTANT else None) for m in ms]
        if None in sides or any(m[5] is None or not any(c.isalnum() for c in m[3] or "") for m in ms):
            continue
        rows = sorted(zip(ms, sides), key=lambda x: (x[0][5], x[1] != "user", x[0][0]))
        turns = [r for n, r in enumerate(rows) if n == 0 or (rows[n - 1][1], rows[n - 1][0][3]) != (r[1], r[0][3])]
        if turns[0][1] != "user" or turns[-1][1] != "assistant" or any(a[1] == b[1] for a, b in pairwise(turns)):
            continue
        out += [(own[k], n, t[0][0]) for n, t in enumerate(turns, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    random.seed(3)
    sessions = [(f"S{k}", "u", "x") for k in range(60)] + [("S1", "u", "x"), (None, "u", "x")]
    rows = []
    for k in range(70):
        for n in range(random.randrange(1, 7)):
            role = ["user", "assistant"][n % 2] if random.random() < 0.93 else random.choice(["Human ", "AI", "system", None, "user", ""])
            text = f"text {k} {n}" if random.random() < 0.95 else random.choice([None, "...", "", "same"])
            when = None if random.random() < 0.02 else at(random.choice([n * 20, n * 90, 5]))
            row = (f"m{k:03}{n}", random.choice([f"s{k}", f" S{k}"]), role, text, None, when, "clash", "clash")
            rows += [row] * random.choice([1, 1, 2])
            if random.random() < 0.1:
                rows.append((f"m{k:03}{n}r", row[1], role, text, None, when, "", ""))
    random.shuffle(rows)
    got = conv.found(spark.createDataFrame(rows, M), spark.createDataFrame(sessions, S)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, sessions)


def test_repeats_at_the_edge_of_hours_are_one_turn(spark):
    rows = [("a", "s", "user", "q", None, at(59), "", ""), ("b", "s", "user", "q", None, at(60), "", ""), ("c", "s", "bot", "r", None, at(200), "", "")]
    got = conv.found(spark.createDataFrame(rows, M), spark.createDataFrame([("s", "", "")], S)).orderBy("turn").collect()
    assert [(r.turn, r.message_id) for r in got] == [(1, "a"), (2, "c")]


def test_lost_messages_follow_replies_and_quotes(spark):
    rows = [
        ("a", "s", "user", "What is it?", None, at(1), "", ""),
        ("b", None, "assistant", "It is this.", '{"reply_to": "a"}', at(2), "", ""),
        ("c", None, "user", "> It is this.\nand why?", None, at(3), "", ""),
        ("d", "", "assistant", "Because.", '{"reply_to": "c"}', at(4), "", ""),
        ("x", None, "user", "alone?", None, at(1), "", ""),
        ("y", None, "assistant", "not quite", '{"reply_to": "x"}', at(2), "", ""),
        ("z", None, "user", "lost", '{"reply_to": "nowhere"', at(2), "", ""),
    ]
    df, sessions = spark.createDataFrame(rows, M), spark.createDataFrame([("s", "", "")], S)
    assert [r.message_id for r in conv.rebuild(df, sessions).orderBy("turn").collect()] == ["a", "b", "c", "d"]
    linked = conv.rebuild(df, sessions, keep_linked=True).where("session_id like 'linked:%'").orderBy("turn").collect()
    assert [r.message_id for r in linked] == ["x", "y"]


def test_empty_tables(spark):
    assert conv.found(spark.createDataFrame([], M), spark.createDataFrame([], S)).count() == 0


def test_components(spark):
    random.seed(5)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 180)] + [(7, 7), (None, 1), (1, None), (300, 301), (301, 300), (300, 301)]
    random.shuffle(links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 180)} | {300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hot_components_keep_every_message(spark):
    # one session holds most messages, half as a chain and half on its first message; every fourth one quotes the one before
    rows, want = [], {}
    for s, size in (("hot", 240), ("s1", 12), ("s2", 9)):
        for n in range(size):
            text, to = f"message {n} of {s}", f"{s}-{0 if n % 2 == 0 and s == 'hot' else n - 1:04}"
            quotes = n % 4 == 3
            meta = None if n == 0 or quotes else f'{{"reply_to": "{to}"}}'
            rows.append((f"{s}-{n:04}", s if n == 0 else None, "user", f"> message {n - 1} of {s}\n{text}" if quotes else text, meta, at(n), "", ""))
            want[f"{s}-{n:04}"] = s
    random.Random(6).shuffle(rows)
    once = conv.one_row_each(spark.createDataFrame(rows, M))
    assert {r.id: r.conversation for r in conv.with_conversation(once).collect()} == want
