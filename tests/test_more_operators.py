import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation, identity, monitor, redaction
from ledgerloom.sources import readers, sinks

XML = """<xbrli:xbrl><xbrli:context id="a"><xbrli:entity><xbrli:segment>
<xbrldi:typedMember dimension="co:TrancheAxis"><co:Id> t 1 </co:Id></xbrldi:typedMember><xbrldi:explicitMember dimension="co:AreaAxis">co:North</xbrldi:explicitMember>
</xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<context id='b'><period><instant> 2023-12-31 </instant></period></context>
<xbrli:unit id="eps"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>
<unit id="usd"><measure>iso4217:USD</measure></unit>
<us-gaap:Eps contextRef="a" unitRef="eps">1.5</us-gaap:Eps><us-gaap:Cash contextRef="b" unitRef="usd"> 7 </us-gaap:Cash><us-gaap:Cash contextRef="b" unitRef="usd">8</us-gaap:Cash>
<us-gaap:Debt contextRef="b" unitRef="usd" xsi:nil="true"/><us-gaap:Lost contextRef="z" unitRef="usd">1</us-gaap:Lost><us-gaap:Note contextRef="b" unitRef="usd">none</us-gaap:Note>
<dei:EntityCentralIndexKey contextRef="b">0042</dei:EntityCentralIndexKey><dei:EntityCentralIndexKey contextRef="b">0043</dei:EntityCentralIndexKey><dei:DocumentType contextRef="a">8-K</dei:DocumentType>
<dei:DocumentFiscalYearFocus contextRef="b">soon</dei:DocumentFiscalYearFocus></xbrli:xbrl>"""


def test_xbrl(spark):
    files = spark.createDataFrame([("f", XML), ("g", None), ("h", "<xbrl/>"), ("i", "<context id='c'><period><instant>2024-01-01</instant></period></context><dei:DocumentType contextRef='c'>10-K</dei:DocumentType>")], "k string, x string")
    got = {(r.concept, r.period, r.dimension, r.unit, r.value) for r in readers.xbrl_values(files, "k", "x").collect()}
    assert got == {("us-gaap:Eps", "2023-01-01/2023-12-31", "co:AreaAxis=co:North;co:TrancheAxis=t 1", "USD/shares", 1.5), ("us-gaap:Cash", "2023-12-31", None, "USD", 7.0)}
    rows = {r.k: r for r in readers.dei_rows(readers.dei_values(files, "k", "x"), "k").collect()}
    assert rows["f"].collection_id == "us-cik-0042" and rows["f"].filing_type is None and rows["f"].fiscal_year is None
    assert rows["i"].collection_id == "us-i" and rows["i"].filing_type == "10-K" and set(rows) == {"f", "i"}


def test_metrics(spark):
    row = spark.sql("select 'a 5 b 7' as t, array('5', '6') as v, array() as none").select(
        evaluation.numeric_match(F.col("t"), F.col("v")).alias("half"),
        evaluation.numeric_match(F.col("t"), F.col("none")).alias("whole"),
        evaluation.identity_accuracy([(F.lit("x"), F.lit("x")), (F.lit(None).cast("string"), F.lit("y")), (F.lit("z"), F.lit(None).cast("string"))]).alias("some"),
        evaluation.identity_accuracy([(F.lit("x"), F.lit(None).cast("string"))]).alias("free"),
    ).first()
    assert tuple(row) == (0.5, 1.0, 0.5, 1.0)
    df = spark.createDataFrame([("See us-gaap:Assets", True), ("plain", False), (None, True)], "t string, ok boolean")
    both = [evaluation.success_rate(F.col("ok")).alias("ok"), evaluation.markup_share(F.col("t")).alias("m")]
    assert df.agg(*both).first() == (2 / 3, 0.5) and df.limit(0).agg(*both).first() == (1.0, 0.0)


def test_market_and_cover(spark):
    assert spark.range(1).select(identity.required_market(F.lit("India/x/y"))).first()[0] == "IN"
    with pytest.raises(Exception, match="no market"):
        spark.range(1).select(identity.required_market(F.lit("mars/x"))).collect()
    items = [
        (1, "p", 0, "title", "Deep", 0, 3), (2, "p", 1, "text", "late", 0, 3), (3, "p", 2, "title", "Head", 0, 2), (4, "p", 3, "text", "x" * 400, 0, 2), (5, "p", 4, "text", "second", 0, 2),
        (6, "h", 0, "title", "Web", 0, None), (7, "h", 1, "text", "one", 0, None), (8, "h", 2, "title", "Next", 0, None), (9, "h", 3, "text", "two", 0, None),
        (10, "t", 0, "title", "Only", 0, 1), (11, None, 0, "text", "lost", 0, 1),
    ]
    df = spark.createDataFrame(items, "item_id bigint, source_doc_id string, seq int, role string, text string, level int, page int")
    got = {r.source_doc_id: r.cover for r in identity.cover_texts(df).collect()}
    assert got == {"p": "Head \n " + "x" * 300, "h": "Web \n one", "t": "Only"}


def test_folding_resets(spark):
    rows = [("a", "upload", 1, None, None, None), ("a", "node", 2, "parse", "failed", None), ("a", "done", 3, None, None, "error"), ("a", "upload", 4, None, None, None), ("a", "node", 5, "detect", "running", None), ("b", "node", 1, "parse", "done", None), ("c", "upload", 9, None, None, None), ("c", "done", 8, None, None, "ok")]
    df = spark.createDataFrame(rows, "u string, k string, n int, stage string, status string, outcome string")
    got = {r.u: (r.stage, r.status, r.outcome) for r in monitor.folded_states(df, "u", "k", "n", "stage", "status", "outcome").collect()}
    assert got == {"a": ("detect", "running", None), "c": (None, None, None)}


def test_fan_out(spark):
    seen = []
    run = sinks.fan_out({"bad": lambda b: 1 / 0, "good": lambda b: seen.append(b.count())})
    assert run(spark.range(3), 0) == {"bad": "division by zero"} and seen == [3]


def test_kinds_union(spark):
    df = spark.createDataFrame([(1, "s", "a@b.co"), (2, "s", "SSN 123-45-6789, c@d.org"), (3, "t", "none"), (4, "t", None)], "id int, s string, text string")
    done = redaction.mask(df, "id", "text").join(df.select("id", "s"), "id")
    assert [(r.s, r.kinds) for r in redaction.kinds_union(done, "s").collect()] == [("s", ["EMAIL", "US_SSN"])]
