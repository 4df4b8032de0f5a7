import random

from ledgerloom.llm import scans

SCHEMA = "item_id bigint, source_doc_id string, seq int, role string, text string, level int, page int, key string, doc string"


def book():
    clean = "The revenue of the company increased in the western cluster and management approved the dividend. insurance holders consolidated share shareholders one-half"
    rows = [(1000 + k, "clean", k, "text", clean, 0, None, "", "") for k in range(30)]
    texts = {
        1: "The revenue of the company increased.",
        2: "Acme Foods - Annual Report\nThe rcvenue of the company incre-\nased in the western cluster.\n[12]",
        3: "Acme Foods - Annual Report\nManagement approved the insur­\nance of 4S.03 million.\n[13]",
        4: "Acme F0ods - Annual Report\nThe holders were consoli-\n[14]",
        5: "Acme Foods - Annual Report\ndated in the one-\nhalf of the cluster.\n[15]",
    }
    rows += [(p, "scan", p, "text", t, 0, p, "x", "y") for p, t in texts.items()]
    rows += [(20, "scan", 6, "title", "Outlook", 0, 2, "", ""), (21, "scan", 7, "title", "Outlook", 0, 4, "", ""), (22, "scan", 8, "table", "[12]", 0, 2, "", ""), (23, "scan", 9, "text", "42.0%", 0, 3, "", "")]
    rows += [(3, *rows[32][1:]), (30, "scan", 10, "text", None, 0, 3, "", ""), (31, "scan", 11, "text", "  ", 0, 3, "", ""), (None, "scan", 12, "text", "x", 0, 3, "", "")]
    return rows


def test_kinds(spark):
    got = {(r.item_id, r.kind) for r in scans.noise(spark.createDataFrame(book(), SCHEMA)).collect()}
    assert {i for i, k in got if k == "header"} == {2, 3, 4, 5}
    assert {i for i, k in got if k == "pageno"} == {2, 3, 4, 5}
    assert {i for i, k in got if k == "hyphen"} >= {2, 3, 4} and (5, "char") not in got
    assert {i for i, k in got if k == "char"} >= {2, 3} and not {i for i, _ in got} & {1, 20, 21, 22, 23, 30, 31}


def test_repair(spark):
    out = {r.item_id: r.text for r in scans.repair(spark.createDataFrame(book(), SCHEMA)).collect()}
    assert out[2] == "The revenue of the company increased in the western cluster."
    assert out[3].startswith("Management approved the insurance of")
    assert out[4] == "The holders were consolidated" and out[5].startswith("in the one-") and out[20] == "Outlook"


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scans.noise(empty).count() == 0 and scans.repair(empty).count() == 0


def test_page_numbers():
    shown = {"[42]": 42, "- 7 -": 7, "(3)": 3, "Page 4 of 9": 4, "2l | P a g e": 21, "F-l8": 18, "xvi": 16, "12": 12, "42.0%": None, "in 2016.": None, "FY2016": None}
    assert {k: scans.page_number(k) for k in shown} == shown


def distance(a, b):
    row = list(range(len(b) + 1))
    for n, x in enumerate(a, 1):
        before, row[0] = row[0], n
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, before + (x != y))
    return row[-1]


def test_near_headers_against_brute_force(spark):
    dice = random.Random(3)

    def edited(key, n):
        for _ in range(n):
            at = dice.randrange(len(key) + 1)
            key = key[:at] + dice.choice(["", "x", "é"]) + key[at + dice.randint(0, 1) :]
        return key

    headers = {"d": ["acmefoodsannualreport", "shorthead", "abcdef", "ab"], "e": ["acmefoodsannualreport", "quitedifferenthere"]}
    rows = [(k, doc, k % 5, h) for doc, hs in headers.items() for k, h in enumerate(hs * 3, 1000 if doc == "d" else 2000)]
    rows += [(1, "d", 1, "acxefoodsannualrexort"), (2, "d", 2, "shoxthead"), (3, "d", 3, "shrtxheadx")]
    rows += [(10 + k, doc, 1, f"{edited(h, dice.randint(1, 6))}") for k, (doc, h) in enumerate((d, h) for d, hs in headers.items() for h in hs * 25)]
    df = spark.createDataFrame([(i, doc, page, "text", 0, None, False, True, key) for i, doc, page, key in rows], "item_id bigint, doc string, page int, role string, at int, shown int, strong boolean, ends boolean, key string")
    got = {r.item_id for r in scans.furniture(df).collect() if r.header}
    seen = {}
    for i, doc, page, key in rows:
        seen.setdefault((doc, key), set()).add(page)
    running = [dk for dk, pages in seen.items() if len(pages) >= 2]
    want = {i for i, doc, page, key in rows if any(doc == d and distance(key, h) <= 3 for d, h in running)}
    assert got == want and {1, 2, 3} <= got < {i for i, *_ in rows}


def test_no_bounds_on_headers_words_and_places(spark):
    long = "Annual report of the " + " ".join(f"division {chr(97 + k)}" for k in range(22)) + " and others"
    assert len(long) > 200
    giant = "over" * 12 + "done"  # a word of 52 letters
    known = [(900 + k, "clean", k, "text", f"the {giant} insurance was approved", 0, None, "", "") for k in range(6)]
    rows = [(p, "scan", p if p < 3 else p * 100, "text", f"{long}\nThe text of page {p} was read and approved.\n[{p + 100000}]", 0, p, "", "") for p in range(1, 6)]
    rows += [(20, "scan", 21, "text", f"We saw that the {giant[:20]}-", 0, 2, "", "")]
    rows += [(21 + k, "scan", 22 + k, "table", "12 | 13", 0, 2, "", "") for k in range(8)]  # tables hold no text
    rows += [(700, "far", 1, "text", "It was the insur-", 0, 1, "", ""), (701, "far", 5000, "text", "ance that was approved", 0, 3, "", "")]
    rows += [(29, "scan", 29 + 1, "text", f"{giant[20:]} insurance was approved.", 0, 2, "", "")]
    df = spark.createDataFrame(known + rows, SCHEMA)
    got = {(r.item_id, r.kind) for r in scans.noise(df).collect()}
    assert {i for i, k in got if k == "header"} == set(range(1, 6)) and {i for i, k in got if k == "pageno"} == set(range(1, 6))
    assert {i for i, k in got if k == "hyphen"} == {20, 700}
    text = {r.item_id: r.text for r in scans.repair(df).collect()}
    assert text[1] == "The text of page 1 was read and approved." and text[20] == f"We saw that the {giant}" and text[29] == "insurance was approved."
    assert text[700] == "It was the insurance" and text[701] == "that was approved"


def test_headers_of_several_lines(spark):
    head = ["Acme Foods Limited", "Annual Report", "Part Two", "For the use of shareholders"]
    rows = [(p, "scan", p, "text", "\n".join([*head, f"Page {p} tells of other matters, and", "of nothing else."]), 0, p, "", "") for p in range(1, 5)]
    found = scans.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in found} == {f"Page {p} tells of other matters, and of nothing else." for p in range(1, 5)}
