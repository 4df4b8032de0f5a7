import datetime as dt

from ledgerloom.llm import survivorship as sur

SCHEMA = "filing_id string, collection_id string, filing_type string, fiscal_year int, fiscal_period string, filed_date date, source_url string, version int, logical_key string, company string, year int"
D = dt.date


def row(i, key, version=1, date=None, kind=None, year=None, period=None, url=None):
    return (i, "c", kind, year, period, date, url, version, key, "clash", 1)


def test_each_field_takes_the_best_member(spark):
    rows = [
        row("b", "Acme Foods Inc. | 10-K/A | FY2020", 2, D(2021, 5, 1), "N/A", 2020, "FY", None),
        row("a", "acme_foods|10-k|2020FY", 2, D(9999, 12, 31), "10-K", 1900, "--", "http://a"),
        row("c", "ACME FOODS|10-K|FY20", 1, D(2021, 3, 1), "10-K", 2020, "FY", "http://c"),
        row("c", "ACME FOODS|10-K|FY20", 1, D(2021, 3, 1), "10-K", 2020, "FY", "http://c"),
        row("d", "acme_foods|10-Q|Q1 FY2020"),
        row("e", None),
        row("f", "  "),
        row(None, "acme_foods|10-K|FY2020", 9),
        row("g", "acme_foods|10-K|", 1, None, None, 2021, "FY", "http://g"),
        row("h", "acme_foods|10-K|FY2021", 1, None, None, None, None, "TBD"),
    ]
    got = {(r.survivor_id, r.field): r.source_id for r in sur.sources(spark.createDataFrame(rows, SCHEMA)).collect()}
    first = {f: got.get(("b", f)) for f in sur.FIELDS}
    assert first == {"filing_type": "a", "fiscal_year": "b", "fiscal_period": "b", "filed_date": "b", "source_url": "a"}
    assert {f: got.get(("g", f)) for f in sur.FIELDS} == {"filing_type": None, "fiscal_year": "g", "fiscal_period": "g", "filed_date": None, "source_url": "g"}
    assert {s for s, _ in got} == {"b", "g"}


def test_ties_go_to_the_smaller_id(spark):
    rows = [row(i, "x|10-K|FY2020", 1, D(2021, 1, 1), "10-K") for i in ("z", "m", "q")]
    assert {r.survivor_id for r in sur.sources(spark.createDataFrame(rows, SCHEMA)).collect()} == {"m"}


def test_empty_table(spark):
    assert sur.sources(spark.createDataFrame([], SCHEMA)).count() == 0
