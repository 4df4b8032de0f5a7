import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import monitor, sqlguard

FACT = "fact_id string, filing_id string, concept string, value double, unit string, period string, dimension string, origin string"
FILING = "filing_id string, collection_id string, fiscal_year int, filed_date date"
GOOD = "SELECT f.value FROM financial_facts f JOIN filings fl ON f.filing_id = fl.filing_id WHERE fl.collection_id = 'c1' AND f.concept = 'us-gaap:NetIncomeLoss'"


@pytest.fixture(scope="module")
def views(spark):
    rows = [(f"f{k:03}", f"g{k % 3}", "us-gaap:NetIncomeLoss" if k % 2 else "no limit 3", float(k), "no limit 3" if k % 5 == 0 else "USD", "2024", None, "xbrl") for k in range(120)]
    filings = spark.createDataFrame([("g0", "c1", 2024, None), ("g1", "c1", 2023, None), ("g2", "c2", 2024, None)], FILING)
    filings = filings.withColumn("filed_date", F.lit("2024-05-01").cast("date"))
    collections = spark.createDataFrame([("c1", "Acme"), ("c2", "Northwind")], "collection_id string, company string")
    return {"financial_facts": spark.createDataFrame(rows, FACT), "filings": filings, "collections": collections}


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT f.value FROM financial_facts f; DROP TABLE filings",
        "DROP TABLE financial_facts",
        "UPDATE financial_facts SET value = 0",
        "DELETE FROM financial_facts",
        "SELECT * FROM users",
        "SELECT value FROM filings",
        "SELECT f.password FROM financial_facts f",
        "SELECT f.value FROM financial_facts f WHERE f.value > (SELECT 1)",
        "SELECT f.value FROM financial_facts f UNION SELECT cik FROM collections",
        "WITH x AS (SELECT 1) SELECT f.value FROM financial_facts f",
        "not sql at all",
        "SELECT value FROM financial_facts WHERE reflect('java.lang.System', 'getProperty', 'user.home') IS NOT NULL",
        "SELECT value FROM financial_facts WHERE java_method('java.lang.Runtime', 'getRuntime') IS NOT NULL",
        "SELECT reflect('java.lang.System', 'exit') FROM financial_facts",
        "SELECT value FROM financial_facts ORDER BY java_method('java.lang.System', 'exit')",
        "SELECT value FROM (SELECT * FROM financial_facts) f",
        "SELECT f.value FROM financial_facts f, filings g",
        "SELECT f.value FROM financial_facts f CROSS JOIN filings g",
        "SELECT f.value FROM financial_facts f WHERE f.filing_id IN (SELECT filing_id FROM filings)",
        "SELECT f.value FROM financial_facts f WHERE EXISTS (SELECT 1 FROM filings)",
        "SELECT count(*) FROM financial_facts GROUP BY concept",
        "SELECT value FROM financial_facts TABLESAMPLE (10 PERCENT)",
    ],
)
def test_refused(spark, statement):
    with pytest.raises(sqlguard.Refused):
        sqlguard.checked(spark, statement)


def test_permitted(spark, views):
    spark.range(3).createOrReplaceTempView("filings")
    out = sqlguard.run(spark, GOOD, views)
    assert out.columns == list(sqlguard.CANONICAL) and out.count() == 40
    assert sqlguard.run(spark, "SELECT * FROM financial_facts f WHERE f.value > 0", views).count() == 50
    assert sqlguard.run(spark, GOOD + " LIMIT 100000", views).count() == 40 and sqlguard.run(spark, GOOD + " ORDER BY f.value DESC LIMIT 5", views).count() == 5
    assert sqlguard.run(spark, GOOD, views, collection="c2").count() == 0
    assert spark.table("filings").count() == 3  # the caller's view stands
    spark.catalog.dropTempView("filings")


def test_words_of_the_language_in_literals(spark, views):
    assert sqlguard.run(spark, "SELECT value FROM financial_facts WHERE unit = 'no limit 3' LIMIT 7", views).count() == 7
    assert sqlguard.run(spark, "SELECT extract(year from g.filed_date) FROM financial_facts f JOIN filings g USING (filing_id) WHERE extract(year from g.filed_date) = 2024", views).count() == 50
    assert sqlguard.run(spark, "SELECT value FROM financial_facts WHERE concept = 'a from b order by c limit 1'", views).count() == 0


def sums(spark, rows):
    df = spark.createDataFrame(rows, "n bigint, up bigint, v bigint")
    return {r.n: r.total for r in monitor.subtree_sums(df, "n", "up", "v").collect()}


def test_spans(spark):
    assert sums(spark, [(1, None, 1), (2, 1, 2), (3, 1, 4), (4, 2, 8), (5, 99, 16), (6, 6, 32)]) == {1: 15, 2: 10, 3: 4, 4: 8, 5: 16, 6: 32}
    assert sums(spark, [(1, None, None), (2, 1, 3), (2, 1, 4)]) == {1: 7, 2: 7}
    assert monitor.subtree_sums(spark.createDataFrame([], "n bigint, up bigint, v bigint"), "n", "up", "v").count() == 0


def test_rings_of_spans_end(spark):
    # 1 and 2 are each other's parents, 3 hangs below 2, 4 below 3; 7 -> 8 -> 9 -> 7
    got = sums(spark, [(1, 2, 1), (2, 1, 2), (3, 2, 4), (4, 3, 8), (7, 9, 1), (8, 7, 1), (9, 8, 1), (10, 7, 5)])
    assert got == {1: 1, 2: 14, 3: 12, 4: 8, 7: 6, 8: 1, 9: 1, 10: 5}


def test_long_chain(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.lit(1).alias("v"))
    out = monitor.subtree_sums(df, "n", "up", "v")
    assert out.where(F.col("total") != n - F.col("n")).count() == 0 and out.count() == n
