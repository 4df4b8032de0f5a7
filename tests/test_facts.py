import datetime as dt

import pytest

from ledgerloom.operators import facts, sqlguard

D = dt.date
F_SCHEMA = "fact_id string, filing_id string, concept string, value double, unit string, period string, dimension string, origin string"
G_SCHEMA = "filing_id string, collection_id string, filing_type string, fiscal_year int, fiscal_period string, filed_date date, source_url string, version int, logical_key string"
C_SCHEMA = "collection_id string, company string, ticker string, cik string, market string, status string"
REV, NI = "us-gaap:Revenues", "us-gaap:NetIncomeLoss"


@pytest.fixture(scope="module")
def store(spark):
    f = [
        ("a1", "f1", REV, 4250.0, "USD", "2024-01-01/2024-12-31", None, "xbrl"),
        ("a2", "f1", REV, 3900.0, "USD", "2023-01-01/2023-12-31", None, "xbrl"),
        ("a3", "f1", REV, 1100.0, "USD", "2024-10-01/2024-12-31", None, "xbrl"),
        ("a4", "f1", REV, 2000.0, "USD", "2024-01-01/2024-12-31", "axis=member", "xbrl"),
        ("a5", "f1", NI, 500.5, "USD", "2024-01-01/2024-12-31", None, "xbrl"),
        ("a6", "f2", REV, 880.0, "USD", "2024-01-01/2024-12-31", None, "xbrl"),
        ("a7", "gone", REV, 1.0, "USD", "FY2024", None, "xbrl"),
    ]
    g = [("f1", "c1", "10-K", 2024, "FY", D(2025, 1, 1), None, 1, "k1"), ("f2", "c2", "10-K", 2024, "FY", None, None, 1, "k2"), ("f2", "c2", "10-K", 2024, "FY", None, None, 1, "k2"), ("f0", "c1", "10-K", 2024, "FY", D(2025, 2, 1), None, 1, "k1")]
    c = [("c1", "Northwind Traders Inc.", "NWND", None, "US", "ok"), ("c2", "Acme, Ltd", None, None, "US", "ok")]
    return spark.createDataFrame(f, F_SCHEMA), spark.createDataFrame(g, G_SCHEMA), spark.createDataFrame(c, C_SCHEMA)


def test_first_write_wins_and_existing_stay(spark, store):
    f, _, _ = store
    more = f.unionByName(spark.createDataFrame([("a1", "f1", REV, 9.0, "USD", "x", None, "xbrl"), (None, "f1", REV, 9.0, "USD", "x", None, "xbrl")], F_SCHEMA))
    out = facts.first_write_wins(more, f.where("fact_id = 'a6'"), "fact_id", ["filing_id", "concept"])
    assert sorted(r.fact_id for r in out.collect()) == ["a1", "a2", "a3", "a4", "a5", "a7"]


def test_orphans_and_index(store):
    f, g, _ = store
    assert [r.fact_id for r in facts.orphans(f, g).collect()] == ["a7"]
    assert facts.concept_index(f, g).count() == 3


def test_latest_and_garbage(store):
    f, g, _ = store
    assert {r.filing_id for r in facts.latest_filings(g).collect()} == {"f0", "f2"}
    kept, filings = facts.collect_garbage(f, g)
    assert {r.fact_id for r in kept.collect()} == {"a6", "a7"} and {r.filing_id for r in filings.collect()} == {"f0", "f2"}


def test_best_fact_is_annual_and_latest(store):
    f, g, _ = store
    best = {(r.collection_id, r.concept): r.value for r in facts.best_facts(facts.with_collection(f.where("dimension is null"), g), ["collection_id", "concept"]).collect()}
    assert best == {("c1", REV): 4250.0, ("c1", NI): 500.5, ("c2", REV): 880.0}


def test_answers(spark, store):
    asked = [(1, "What was the revenue of Northwind in FY2023?"), (2, "NWND net income"), (3, "revenue of acme in 2099"), (4, "revenue of nobody"), (5, "weather of Northwind"), (6, None), (7, "Acme's total revenue")]
    out = {r.id: (r.value, r.answer) for r in facts.answer_questions(spark.createDataFrame(asked, "id int, text string"), *store).collect()}
    assert out == {1: (3900.0, "revenue for FY2023: $3,900"), 2: (500.5, "net income for FY2024: $500.50"), 7: (880.0, "revenue for FY2024: $880")}


def test_empty(spark, store):
    f, g, c = (x.limit(0) for x in store)
    assert facts.concept_index(f, g).count() == 0 and facts.latest_filings(g).count() == 0 and facts.orphans(f, g).count() == 0


GOOD = "SELECT f.value FROM financial_facts f JOIN filings g ON f.filing_id = g.filing_id WHERE g.collection_id = 'c1' AND f.concept = 'us-gaap:Revenues'"
BAD = [
    "DROP TABLE financial_facts", "SELECT 1", "SELECT company FROM collections", "SELECT value FROM financial_facts; SELECT 1", "INSERT INTO financial_facts VALUES (1)", "SELECT secret FROM financial_facts",
    "SELECT value FROM financial_facts WHERE value > (SELECT max(value) FROM financial_facts)", "SELECT value FROM financial_facts UNION SELECT value FROM financial_facts", "SELECT value FROM other.users", "not sql at all", "SELECT value FROM financial_facts WHERE EXISTS (SELECT 1 FROM filings)",
]


def test_guard(spark, store):
    views = dict(zip(("financial_facts", "filings", "collections"), store))
    out = sqlguard.run(spark, GOOD, views)
    assert out.columns == list(sqlguard.CANONICAL) and out.count() == 4
    assert sqlguard.run(spark, GOOD + " LIMIT 2", views).count() == 2 and sqlguard.checked(spark, GOOD + " LIMIT 5000")[1] == 50
    assert sqlguard.run(spark, "SELECT * FROM financial_facts", views, "c2").count() == 1
    assert sqlguard.from_reply("Sure:\n```sql\nSELECT 1 FROM t;\n```") == "SELECT 1 FROM t"


@pytest.mark.parametrize("statement", BAD)
def test_guard_refuses(spark, statement):
    with pytest.raises(sqlguard.Refused):
        sqlguard.checked(spark, statement)
