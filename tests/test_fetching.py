"""Guarded fetching, robots rules with a time to live, site tools, replies, settings."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.config import load_config
from loomline.functions import text as T
from loomline.operators import ingest, retrieval
from loomline.plans import pipelines
from loomline.session import checkpointed
from loomline.sources import pages as P
from loomline.sources import tools
from loomline.sources.store import Collection

LINKS = "array<struct<text:string,href:string>>"
AS_OF = "2024-01-02 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _cache(spark):
    rows = [
        (1, "https://a.example/x", "old", "c1", None, "2024-01-01T10:00:00"), (2, "https://a.example/x", "newer", "c2", [("t", "h")], "2024-01-01T12:00:00"),
        (3, "https://a.example/stale", "stale", "c3", None, "2023-01-01T00:00:00"), (4, "https://a.example/kept", "kept", "c4", None, "2024-01-01T20:00:00"),
    ]
    return spark.createDataFrame(rows, f"page_id int, url string, title string, content string, links {LINKS}, scraped_at string")


def _getter():
    def get(url):  # a function of its own, as workers do not import the tests
        if url.endswith("robots.txt"):
            if "c.example" in url:
                raise OSError("down")
            return "User-agent: *\nDisallow: /private"
        if url.endswith("broken"):
            raise OSError("no")
        return None if url.endswith("empty") else f"<h1>T</h1><p>{url}</p><a href='/on'>on</a>"

    return get


def test_robots_rules_are_kept_for_their_time(spark):
    urls = spark.createDataFrame([(u,) for u in ("https://a.example/private/1", "https://b.example/private/2", "https://b.example/3", "https://c.example/private/4", "none", None)], "url string")
    known = spark.createDataFrame([("a.example", "User-agent: *\nAllow: /", "2024-01-01T12:00:00"), ("b.example", "User-agent: *\nAllow: /", "2023-12-01T00:00:00")], "host string, text string, fetched_at string")
    rules = P.robots_rules(urls, known, _getter(), _as_of())
    assert {(r.host, r.text is None, r.fetched_at) for r in rules.collect()} == {("a.example", False, "2024-01-01T12:00:00"), ("b.example", False, "2024-01-02T00:00:00"), ("c.example", True, "2024-01-02T00:00:00")}
    assert {r.url for r in P.allowed(urls, rules).collect()} == {"https://a.example/private/1", "https://b.example/3", "https://c.example/private/4", "none", None}


def test_pages_come_from_the_cache_or_are_read(spark):
    urls = spark.createDataFrame([(f"https://a.example/{x}",) for x in ("x", "x", "stale", "new", "private/y", "empty", "broken")] + [(None,)], "url string")
    read = checkpointed(P.fetch_pages(urls, _cache(spark), _getter(), _as_of(), {"a.example": "User-agent: *\nDisallow: /private"}, retries=2, pause=lambda n: 0.0))
    got = {r.url.rsplit("/", 1)[-1]: (r.title, r.cached, r.error) for r in read.collect()}
    assert got == {
        "x": ("newer", True, None), "stale": ("T", False, None), "new": ("T", False, None), "y": (None, False, "disallowed"), "empty": (None, False, "no content"), "broken": (None, False, "OSError: no"),
    }
    merged = {r.url.rsplit("/", 1)[-1]: (r.title, r.scraped_at) for r in P.merged_cache(_cache(spark), read, _as_of()).collect()}
    assert merged == {"x": ("newer", "2024-01-01T12:00:00"), "kept": ("kept", "2024-01-01T20:00:00"), "stale": ("T", "2024-01-02T00:00:00"), "new": ("T", "2024-01-02T00:00:00")}
    assert P.fetch_pages(urls.limit(0), _cache(spark), _getter(), _as_of()).count() == 0


def test_copies_of_a_page_are_one(spark):
    cache = _cache(spark)
    assert {(r.url[-1], r.title) for r in P.one_copy(cache).collect()} == {("x", "newer"), ("e", "stale"), ("t", "kept")}
    assert P.follow_pages(cache.select("url").distinct(), cache).count() == 3


def test_site_tools(spark):
    known = tools.site_tools("https://o.example/", "https://c.example")
    assert len(known) == 7 and known["official_page"].schema()["required"] == ["path"]
    rows = [(u, u.rsplit("/", 1)[-1], "text", None) for u in ("https://o.example/housing-for-ukraine", "https://o.example/council-housing", "https://o.example/housing/other", "https://c.example/nhs", "https://c.example/nhs/gp-registration")]
    pages = spark.createDataFrame(rows, f"url string, title string, content string, links {LINKS}")
    page = lambda name, **a: [r.page.split("\n")[0] if r.page else r.error for r in tools.call(pages, name, a, known).collect()]
    assert page("official_housing") == page("official_scheme") == page("official_page", path="housing-for-ukraine") == ["# housing-for-ukraine"]
    assert page("official_housing", topic="Council") == ["# council-housing"] and page("official_housing", topic="other") == ["# other"]
    assert page("community_health") == ["# nhs"] and page("community_health", topic="gp-registration") == ["# gp-registration"]
    assert page("official_housing", topic="/council-housing") == ["# council-housing"] and page("community_page", path="/none") == []
    assert page("community_page") == ["Missing parameter: path"] and page("x") == ["Unknown tool: x"]
    topics = spark.createDataFrame([("council",), ("Renting",), ("/p",), ("z",), ("",), (None,)], "t string")
    for r in topics.select("t", tools.OFFICIAL_HOUSING.path_column(F.col("t")).alias("p")).collect():
        assert r.p == tools.OFFICIAL_HOUSING.path(r.t)


def test_fuller_page(spark):
    page = "struct<content:string>"
    rows = [("housing", ("a" * 300,), ("b" * 900,), "a"), ("housing", ("a" * 10,), ("b" * 20,), "b"), ("housing", ("a" * 10,), ("b",), "a"), ("health", ("a" * 10,), ("b",), "b"), ("health", None, ("b",), "b"), ("health", ("a",), None, "a"), ("housing", None, None, None)]
    df = spark.createDataFrame(rows, f"s string, x {page}, y {page}, want string")
    for r in df.select("want", T.fuller_page(F.col("x"), F.col("y"), F.col("s")).alias("p")).collect():
        assert (r.p.content[0] if r.p else None) == r.want


def test_messages_are_answered_in_order(spark):
    docs = spark.createDataFrame([("Visas are extended at the city office. Bring a passport.", "u1", "s", "Visa")], "text string, url string, source string, title string")
    points = pipelines.index_documents(docs, 64)
    rows = [
        (1, 7, "2024-01-01 00:00:00", "@b Where are visas extended at the office?", "group", False), (2, 7, "2024-01-01 00:00:01", "unheard", "group", False), (3, 7, "2024-01-01 00:00:02", "второй вопрос, пожалуйста это", "private", False),
        (4, 7, "2024-01-01 00:00:03", "third", "private", False), (5, 8, "2024-01-01 00:00:00", " ", "private", False), (6, 8, "2024-01-01 00:00:00", "edited", "private", True), (7, 8, None, "no time", "private", False),
    ]
    messages = spark.createDataFrame(rows, "message_id int, user_id int, ts string, text string, chat_type string, is_edited boolean").selectExpr("message_id", "user_id", "cast(ts as timestamp) ts", "text", "chat_type", "false is_command", "is_edited", "false is_reply")
    replies = pipelines.reply_messages(messages, points, "b", 64, limit=2, translate=lambda q: F.concat(F.lit("UK "), q), validate=lambda r: ~F.contains(r, F.lit("unsafe")), safe_reply="safe", threshold=0.3)
    got = {r.message_id: r for r in replies.collect()}
    assert {k: r.status for k, r in got.items()} == {1: "answered", 3: "answered", 4: "rate_limited", 5: "empty_message", 7: "rate_limited"}
    assert got[1].reply.startswith("Visas are extended") and got[1].question.startswith("Where") and got[3].question.startswith("UK ") and got[3].language == "ru"
    assert got[4].reply == pipelines.NOTICES["rate_limited"] and got[4].intent is None and got[3].reply == ""

    def send(user, text, marked_up):
        if marked_up and "*" in text or text == "lost":
            raise ValueError("marks")

    out = spark.createDataFrame([(1, "fine"), (2, "a * b"), (3, "lost"), (4, ""), (5, None)], "user_id int, reply string")
    assert {tuple(r) for r in pipelines.send_replies(out, send).collect()} == {(1, "markdown", None), (2, "plain", None), (3, "", "ValueError: marks")}


def test_reply_stream(spark, tmp_path):
    spark.createDataFrame([(1, "hello"), (2, "there")], "user_id int, reply string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id int, reply string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "sent")

    def send(user, text, marked_up):
        with open(f"{out}-{user}", "w") as f:
            f.write(text)

    pipelines.reply_stream(stream, send, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert [open(f"{out}-{k}").read() for k in (1, 2)] == ["hello", "there"]


def test_migrated_documents(spark):
    docs = spark.createDataFrame([(1, "2024-05-05", None, "x"), (2, None, "2024-01-03", "y"), (3, None, "junk", None), (4, None, None, "z")], "k int, document_date string, last_updated string, text string")
    got = {r.k: r.document_date for r in ingest.migrated_documents(docs, F.lit("2025-06-01").cast("date")).collect()}
    assert got == {1: "2024-05-05", 2: "2024-01-03", 3: "2023-01-01", 4: "2024-06-01"}


def test_health_states(spark, tmp_path):
    class Broken:
        def describe(self):
            raise OSError("gone")

    assert retrieval.health_state(None)["status"] == "not_initialized" and retrieval.health_state(Broken())["error"] == "OSError: gone"
    collection = Collection(spark, str(tmp_path / "c"), 2)
    assert retrieval.health_state(collection)["status"] == "collection_not_found"
    collection.create(2)
    assert retrieval.health_state(collection) == {"status": "healthy", "n_points": 0, "dimensions": 2}


def test_config(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "a.toml").write_text("[b]\nc = 2\n")
    assert load_config(str(tmp_path / "a.json")) == {"a": 1} and load_config(str(tmp_path / "a.toml")) == {"b": {"c": 2}}
    with pytest.raises(OSError):
        load_config(str(tmp_path / "none.json"))
