"""The vector collection, page tools, link discovery, and the message gate on a stream."""

import pytest
from pyspark.sql import functions as F

from loomline.plans import pipelines
from loomline.sources import store, tools


def test_collection(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "points"), 4)
    assert c.describe()["status"] == "collection_not_found"
    assert c.create(2) and not c.create(2) and c.describe() == {"status": "healthy", "n_points": 0, "dimensions": 2}
    schema = "point_id string, embedding array<float>, text string, source string"
    c.upsert(spark.createDataFrame([("a", [1.0, 0.0], "ta", "s"), ("b", [0.0, 1.0], "tb", "t"), ("c", None, "tc", "s"), ("d", [1.0, 1.0], "", "s")], schema))
    c.upsert(spark.createDataFrame([("a", [0.6, 0.8], "ta2", "s"), ("e", [1.0, 0.1], "te", "t")], schema))
    assert {(r.point_id, r.text) for r in c.points().collect()} == {("a", "ta2"), ("b", "tb"), ("e", "te")}
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [(r.point_id, r["rank"]) for r in c.search(query, 2, None).orderBy("rank").collect()] == [("e", 1), ("a", 2)]
    assert [r.point_id for r in c.search(query, 2, 0.5, {"source": "s"}).collect()] == ["a"]
    with pytest.raises(Exception, match="another length"):
        c.upsert(spark.createDataFrame([("x", [1.0], "t", "s")], schema))
    assert c.drop() and not c.exists()


def test_run_artefacts(spark, tmp_path):
    one = spark.createDataFrame([("t", None)], "text string, note string")
    store.write_run(one, one, one, str(tmp_path), "20240101_000000")
    assert spark.read.json(str(tmp_path / "chunks_20240101_000000")).columns == ["note", "text"]


def test_tools_and_discovery(spark):
    rows = [
        ("https://a.example/housing/x", "T", "body", [("Ukraine help", "/ukraine"), ("Log", "/login"), ("Out", "https://b.example/ukraine")]),
        ("https://a.example/health/y", None, None, None),
    ]
    pages = spark.createDataFrame(rows, "url string, title string, content string, links array<struct<text:string,href:string>>")
    assert tools.call(pages, "get_page", {"url": "https://a.example/housing/x"}).first().page.startswith("# T\n\n**Source:** https://a.example/housing/x")
    assert tools.call(pages, "get_section", {"section": "health", "host": "a.example"}).count() == 1
    assert tools.call(pages, "none", {}).first().error == "Unknown tool: none"
    assert tools.call(pages, "get_page", {}).first().error == "Missing parameter: url"
    assert tools.TOOLS["get_section"].schema()["required"] == ["section"]
    assert {r.url for r in tools.linked(pages, tools.TOPIC_WORDS).collect()} == {"https://a.example/ukraine", "https://b.example/ukraine"}
    assert {r.url for r in tools.linked(pages, host="a.example").collect()} == {"https://a.example/ukraine"}


def test_gate_on_a_stream(spark, tmp_path):
    schema = "user_id int, text string, chat_type string, is_command boolean, is_edited boolean, is_reply boolean"
    rows = [(1, "@b Як справи?", "group", False, False, False), (2, "no", "group", False, False, False), (3, "hi", "private", False, True, False), (4, "click here http://x", "private", False, False, False)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = pipelines.gate_messages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "b")
    query = stream.writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.user_id, r.question, r.rejected, r.language) for r in spark.table("gated").select(F.col("user_id"), "question", "rejected", "language").collect()}
    assert got == {(1, "Як справи?", "", "uk"), (4, "click here http://x", "spam_detected", "unknown")}
