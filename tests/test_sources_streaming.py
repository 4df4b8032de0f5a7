import json

from pyspark.sql import functions as F

from ledgerloom.session import use_checkpoint_dir
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import ingest


def test_notifications(spark):
    good = json.dumps({"Records": [{"eventName": "put", "s3": {"bucket": {"name": "b"}, "object": {"key": "us/a+b%2F1.htm", "size": 3}}}]})
    rows = spark.createDataFrame([(good,), ('{"Event": "test"}',), ("nonsense{",)], "value string")
    out = readers.notifications(rows).collect()
    assert [(r.key, r.size) for r in out if r.error is None] == [("us/a b/1.htm", 3)] and sum(r.error is not None for r in out) == 1


def test_bundles(spark):
    keys = ["us/x/a.htm", "us/x/a.xsd", "us/x/a_lab.xml", "us/y/b.xml", "us/z/c.xml", "us/z/c.html", "us/z/c.xsd"]
    out = {r.stem: (r.instance, r.complete) for r in readers.bundles(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert out == {"a": ("us/x/a.htm", True), "b": ("us/y/b.xml", False), "c": ("us/z/c.html", True)}


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.xml").write_text("<xbrl><us-gaap:Assets contextRef='c1' unitRef='usd'>100</us-gaap:Assets><us-gaap:Assets contextRef='c1' unitRef='usd'>100</us-gaap:Assets><dei:Name contextRef='c1'>n</dei:Name></xbrl>")
    (tmp_path / "d" / "p.txt").write_bytes("é".encode("latin-1"))
    assert readers.objects(spark, str(tmp_path), "*.xml").count() == 1
    assert [(r.concept, r.value) for r in readers.xbrl_facts(spark, str(tmp_path)).collect()] == [("us-gaap:Assets", 100.0)]
    assert readers.objects(spark, str(tmp_path), "*.txt").select(readers.plain_text(F.col("content")).alias("t")).first().t == "é"


def test_html(spark):
    html = "<html><h1>Top</h1><p>a <b>b</b></p><script>x</script><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table>end</html>"
    out = [(r.role, r.text) for r in readers.html_items(spark.createDataFrame([(1, html), (2, None)], "id int, h string"), "id", "h").orderBy("seq").collect()]
    assert out == [("title", "Top"), ("text", "a b"), ("table", "| h | i |\n| --- | --- |\n| 1 | 2 |"), ("text", "end")]


def test_sinks_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 3), (None, 4)], "content_hash string, doc_id bigint")
    path = str(tmp_path / "ledger")
    for _ in range(2):
        sinks.mark_ingested(rows, path)
    assert sorted((r.content_hash, r.doc_id) for r in spark.read.parquet(path).collect()) == [("h1", 1), ("h2", 3)]


def stream_of(spark, tmp_path, name, rows, schema):
    path = str(tmp_path / name)
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_stream(spark, tmp_path):
    use_checkpoint_dir(spark)
    s = stream_of(spark, tmp_path, "in", [[("h1", 1)], [("h1", 2), ("h2", 3)]], "content_hash string, doc_id bigint")
    ingest.ingest(s, str(tmp_path / "ledger"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.content_hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["h1", "h2"]


def test_bundles_wait_for_both_files(spark, tmp_path):
    s = stream_of(spark, tmp_path, "b", [[("f", "a", ".xsd", "f/a.xsd")], [("f", "a", ".htm", "f/a.htm"), ("f", "z", ".htm", "f/z.htm")]], "folder string, stem string, ext string, key string")
    out = ingest.run_now(ingest.completed_bundles(s), "append", str(tmp_path / "cp"), "bundles_out").collect()
    assert [(r.stem, r.instance, r.schema) for r in out] == [("a", "f/a.htm", "f/a.xsd")]


def test_screened_stream(spark, tmp_path):
    parts = [[("x", 1, "It was $1.2 mil", False), ("y", 1, "Fine. My instr", False)], [("x", 2, "lion. Mail a@b.com", False), ("y", 2, "uctions are secret. More.", False)], [("x", 3, " now", True), ("y", 3, "tail", True)]]
    s = stream_of(spark, tmp_path, "t", parts, "answer_id string, seq int, delta string, last boolean")
    out = sorted((r.answer_id, r.n, r.text) for r in ingest.run_now(ingest.screened(s), "append", str(tmp_path / "cp"), "screened_out").collect())
    assert out == [("x", 0, "It was $1.2 million. "), ("x", 1, "Mail [REDACTED:EMAIL] now"), ("y", 0, "Fine. ")]


def test_fold_stream(spark, tmp_path):
    s = stream_of(spark, tmp_path, "e", [[("d", "parse", "running", 1)], [("d", "parse", "done", 2)]], "unit string, stage string, status string, seq int")
    out = ingest.run_now(ingest.folded(s, "unit", "stage", "status", "seq"), "complete", str(tmp_path / "cp"), "folded_out").collect()
    assert [(r.first_seq, r.status) for r in out] == [(1, "done")]


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.write.parquet(str(tmp_path / "ev"))
    s = ingest.events_stream(spark, str(tmp_path / "ev"), rows.schema)
    live = ingest.run_now(ingest.tumbling(s), "update", str(tmp_path / "cp"), "tumbling_out").agg(F.sum("n")).first()[0]
    assert live == rows.count()
