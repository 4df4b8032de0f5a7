import random
import re

from pyspark.sql import functions as F

from ledgerloom.functions import rules
from ledgerloom.llm import conversations
from ledgerloom.operators import chat, redaction
from ledgerloom.plans import catalog


def run(spark, folder, name, **tables):
    """A registered query over small tables: name=(rows, schema)."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return catalog.QUERIES[name](spark, str(folder)).collect()


def test_titles_in_any_script(spark, tmp_path):
    texts = ["plain  text\n", "“Umsatz” – 5 €", "राजस्व " * 20, "売上高　は増加  した", "é" * 60, "😀" * 61, "a" * 59 + "   b", " ", "", None]
    out = {r.doc_id: r.title for r in run(spark, tmp_path, "auto_titles", documents=(list(enumerate(texts)), "doc_id bigint, text string"))}
    bare = [" ".join(t.split()) for t in texts if t is not None]
    assert out == {k: t if len(t) <= 60 else t[:60].rstrip() + "…" for k, t in enumerate(bare)}


MESSAGES = "id string, session_id string, role string, text string, meta string, created_at timestamp"


def test_mail_addresses_beside_any_script(spark, tmp_path):
    texts = {"a": "to a.b@c.com", "b": "“café” a@b.com, c@d.org", "c": "x\u00a0a@b.com\u00a0y", "d": "é.x@y.com", "e": "éx@y.de", "f": "写a@b.comへ", "g": "naïve", "h": None, "i": "a@b é", "j": "a@b.comé", "k": "-x@y.com_"}
    rows = [(k, "s", "user", t, None, None) for k, t in texts.items()]
    out = {r.id: r.n for r in run(spark, tmp_path, "email_counts", chat_messages=(rows, MESSAGES))}
    form = re.compile(redaction.FORMS["EMAIL"], re.ASCII)
    assert out == {k: n for k, t in texts.items() if t and (n := len(form.findall(t)))} and out["b"] == 2 and out["f"] == 1


def test_grounding_without_the_text_of_a_session(spark, tmp_path):
    dice = random.Random(7)
    number = lambda: dice.choice(["7", "42", "4,250", "4,250.75", "2024", "1,", "0.5", "12.", "9" * 40, "1.2.3", "3,1.4"])
    roles = {"user": "user", " Human ": "user", "usr": "user", "assistant": "assistant", "AI": "assistant", "bot:": "assistant", "model": "assistant", "system": None, None: None}
    rows = [(f"m{k}", dice.choice(["s", "s", "t", "u", None]), dice.choice(list(roles)), "x" + dice.choice([" ", "", "é", "-"]).join(number() for _ in range(dice.randint(0, 4))) + dice.choice(["", " [1]", "[12]3"]), None, None) for k in range(80)]
    rows += [("n", "v", "bot", "5", None, None), ("q", "w", "human", None, None, None), ("r", "w", "ai", "5", None, None), ("v1", "z", "human", "cost 1,500", None, None), ("v2", "z", "bot", "500 or 15", None, None), ("v3", "z", "ai", "none", None, None)]
    rows += [rows[0]]
    got = run(spark, tmp_path, "numeric_grounding", chat_messages=(rows, MESSAGES))
    want = {}
    for k, s, role, text, *_ in rows:
        said = [t for _, s2, r2, t, *_ in rows if s and s2 == s and roles.get(r2, "user" if r2 == "human" else "assistant") == "user" and t is not None]
        if said and roles.get(role, "user" if role == "human" else "assistant") == "assistant":
            nums = re.findall(r"[0-9][0-9,]*(?:\.[0-9]+)?", re.sub(r"\[[0-9]+\]", " ", text))
            want[k] = (len(nums), round(sum(any(n in t for t in said) for n in nums) / len(nums), 6) if nums else 1.0)
    assert {r.id: (r.figures, r.grounding) for r in got} == want and len(got) == len(want)
    assert want["v2"] == (2, 0.5) and want["v3"] == (0, 1.0) and "n" not in want and "r" not in want
    df = spark.read.parquet(f"{tmp_path}/chat_messages.parquet")
    assert "collect_" not in chat.numeric_grounding(df)._jdf.queryExecution().optimizedPlan().toString()


def test_roles_of_the_core_and_of_conversations(spark):
    words = [*conversations.USER, *conversations.ASSISTANT, " Human:", "\u00a0AI ", "system", "", None]
    df = spark.createDataFrame([(w,) for w in words], "r string")
    assert all(r.a == r.b for r in df.select(rules.side(F.col("r")).alias("a"), conversations.side(F.col("r")).alias("b")).collect())


def test_every_message_that_names_a_company_is_searched(spark, tmp_path):
    said = {
        "a": ("user", "Which risks does Lyston mention?"), "b": ("user", "which risks does lyston mention?"), "c": ("Human", "What was net debt of LYS in 2020?"), "d": ("assistant", "Net debt of Lyston rose [1]."),
        "e": (None, "Invoice me. Which risks does Lyston's plant name"), "f": ("user", "Which risks does nobody mention?"), "g": ("user", None), "h": ("user", "net debt?"), "i": ("user", "Does Norfield mention debt?"),
    }
    chunks = [("k1", "net debt and risks", ("c1", None, None)), ("k2", "the plant does mention risks", ("c1", None, None)), ("k3", "debt", ("c2", None, None))]
    got = run(
        spark, tmp_path, "scoped_fused", chat_messages=([(k, "s", role, text, None, None) for k, (role, text) in said.items()], MESSAGES),
        collections=([("c1", "Lyston Foods", "LYS"), ("c2", "Norfield Ltd", None)], "collection_id string, company string, ticker string"),
        chunks=(chunks, "chunk_id string, text string, metadata struct<collection_id: string, logical_key: string, source_revision: int>"),
    )
    hits = {q: {r.key for r in got if r.query == q} for q in {r.query for r in got}}
    assert hits == {"a": {"k1", "k2"}, "b": {"k1", "k2"}, "c": {"k1"}, "d": {"k1"}, "e": {"k1", "k2"}, "i": {"k3"}}
