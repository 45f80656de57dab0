"""Documents from files, pages from a cache, HTML."""

import json

from pyspark.sql import functions as F

from loomline.functions import html as H
from loomline.sources import documents as D
from loomline.sources import pages as P


def test_json_shapes_and_defaults(spark, tmp_path):
    active = tmp_path / "docs" / "active"
    (active / "deep").mkdir(parents=True)
    (tmp_path / "docs" / "archive").mkdir()
    full = {"text": " T1 ", "metadata": {"source": "s", "title": None, "url": "u", "document_date": "2024-01-02"}}
    (active / "list.json").write_text(json.dumps([full, {"content": "T2", "title": "top", "url": "topurl", "date": "2024-03-04"}, {"text": "", "content": "T3", "metadata": {}}, {"other": 1}, {"text": "  "}]))
    (active / "deep" / "wrapped.json").write_text(json.dumps({"documents": [{"text": "T4"}]}))
    (active / "one.json").write_text(json.dumps({"text": "T5", "metadata": {"last_updated": "2023-01-01"}}))
    (active / "README.json").write_text(json.dumps([{"text": "no"}]))
    (active / "bad.json").write_text('[{"text": "cut')
    (tmp_path / "docs" / "archive" / "old.json").write_text(json.dumps([{"text": "old"}]))
    rows = {r.text: r for r in D.load_documents(spark, str(tmp_path / "docs"), use_active_folder=True, as_of="2025-01-01").collect()}
    assert set(rows) == {"T1", "T2", "T3", "T4", "T5"}
    assert (rows["T1"].source, rows["T1"].title, rows["T1"].url, rows["T1"].document_date) == ("s", None, "u", "2024-01-02")
    assert (rows["T2"].source, rows["T2"].title, rows["T2"].url, rows["T2"].document_date) == ("manual", "top", "topurl", "2024-03-04")
    assert rows["T3"].title == "list" and rows["T3"].url.startswith("file:///") and rows["T3"].file == "list.json"
    assert rows["T5"].document_date == "2023-01-01" and {r.document_type for r in rows.values()} == {"manual"}
    assert D.load_documents(spark, str(tmp_path / "docs")).where("text = 'old'").count() == 1
    assert D.load_documents(spark, str(tmp_path / "none")).count() == 0 and D.load_documents(spark, str(tmp_path), "csv").count() == 0


def test_text_and_markdown(spark, tmp_path):
    (tmp_path / "my_first-note.txt").write_text("  body \n")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "guide.md").write_text("intro\n# The Title\ntext")
    (tmp_path / "plain_file.md").write_text("no heading")
    (tmp_path / "readme.md").write_text("# No")
    assert [(r.text, r.title, r.type) for r in D.load_documents(spark, str(tmp_path), "txt").collect()] == [("body", "My First Note", "text")]
    assert {r.title for r in D.load_documents(spark, str(tmp_path), "markdown").collect()} == {"The Title", "Plain File"}


def test_written_documents_come_back(spark, tmp_path):
    docs = spark.createDataFrame([("a", "s", None), ("b\nc", None, 2)], "text string, source string, n long")
    D.write_documents(docs, str(tmp_path / "out"))
    assert sorted(map(tuple, D.read_written(spark, str(tmp_path / "out")).select("text", "source", "n").collect()), key=str) == sorted([("a", "s", None), ("b\nc", None, 2)], key=str)


PAGE = """<html lang="uk"><head><title>Head - GOV.UK</title><meta name="description" content="D"></head><body><header><a href="/h">H</a></header><nav><p>menu</p></nav>
<article><h1>Main <b>Title</b></h1><time datetime="2024-01-02">x</time><p>First paragraph is long enough</p><p>Print this page, please do it</p><p>short</p><ul><li>an item that counts<li>no</ul>
<a href="/link1">Link <i>1</i></a><a href="">none</a><script>var p = "<p>no</p>"</script></article><p>outside the article, long enough</p><footer><p>f</p></footer></body></html>"""


def test_html():
    generic = H.read_page(PAGE, "https://h.example/d/")
    assert generic["title"] == "MainTitle" and generic["language"] == "uk" and generic["description"] == "D" and generic["publication_date"] == "2024-01-02"
    assert generic["content"].split("\n\n") == ["First paragraph is long enough", "Print this page, please do it", "short", "outside the article, long enough"]
    assert generic["links"] == [{"text": "Link1", "href": "https://h.example/link1"}]
    official = H.read_page(PAGE, None, H.OFFICIAL)
    assert official["content"] == "First paragraph is long enough\n\n• an item that counts" and official["num_paragraphs"] == 3
    assert H.read_page("<title>T - GOV.UK</title><p>x", None, H.OFFICIAL)["title"] == "T"
    assert H.read_page(None) is None and H.read_page("  ") is None and H.read_page("<p>a<p>b")["content"] == "a\n\nb" and H.read_page("x")["title"] == "Untitled"


def test_html_read_whole():
    page = '<body><div class="x main-content"><p>One <b>two</b></p>\n\n three <aside>no</aside><p>' + "four " * 30 + '</p></div><p>outside</p></body>'
    assert H.read_page(page, None, H.COMMUNITY_WHOLE)["content"] == "One two\nthree " + ("four " * 30).strip()
    assert H.read_page('<div id="content">' + "a " * 60 + "</div><main>b</main>", None, H.COMMUNITY_WHOLE)["content"] == ("a " * 60).strip()
    lettered = "<body>menu<p>short і</p><p>" + "їжа та дім " * 12 + "</p></body>"
    assert H.read_page(lettered, None, H.COMMUNITY_WHOLE)["content"] == ("їжа та дім " * 12).strip()
    assert H.read_page("<body>too short</body>", None, H.OFFICIAL_WHOLE) is None


def test_html_column(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "k int, html string")
    rows = {r.k: r.p for r in df.select("k", H.page(F.col("html")).alias("p")).collect()}
    assert rows[1].num_links == 1 and rows[2].title is None and rows[3].title is None


def test_cache(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    cache = spark.createDataFrame([(1, "u1", "2024-01-01T12:00:00"), (2, "u2", "2023-12-01T00:00:00"), (3, "u3", "junk"), (4, "u4", None), (5, "u1", "2024-01-01T13:00:00")], "page_id int, url string, scraped_at string")
    assert {r.page_id for r in P.fresh(cache, as_of).collect()} == {1, 5} and {r.page_id for r in P.expired(cache, as_of).collect()} == {2, 3, 4}
    urls = spark.createDataFrame([("u1",), ("u2",), ("u9",)], "url string")
    assert {r.url for r in P.to_fetch(urls, cache, as_of).collect()} == {"u2", "u9"}
    assert {(r.page_id, r.n_copies) for r in P.newest_copies(cache).collect()} == {(5, 2), (2, 1), (3, 1), (4, 1)}


def test_fetch_and_robots(spark):
    urls = spark.createDataFrame([("https://a.example/x",), ("https://a.example/private/y",), ("https://b.example/bad",)], "url string")
    rules = {"a.example": "User-agent: *\nDisallow: /private"}
    assert {r.url for r in P.allowed(urls, rules).collect()} == {"https://a.example/x", "https://b.example/bad"}

    def get(url):
        if "bad" in url:
            raise OSError("no")
        return "<p>ok</p>" if url.endswith("/x") else None

    got = {r.url: (r.html, r.error) for r in P.fetch(urls, get, retries=2, pause=lambda n: 0.0).collect()}
    assert got == {"https://a.example/x": ("<p>ok</p>", None), "https://a.example/private/y": (None, "no content"), "https://b.example/bad": (None, "OSError: no")}


def test_pagination(spark):
    link = lambda t, h: [(t, h)]
    rows = [("p1", "T", "one", link("next", "p2"), (2, "2024-01-01")), ("p2", "T2", "two", link("далі", "p3"), (3, None)), ("p3", "T3", "three", link("next", "p1"), (1, "2024-02-02")), ("q", "Q", "alone", None, (1, None))]
    pages = spark.createDataFrame(rows, "url string, title string, content string, links array<struct<text:string,href:string>>, metadata struct<num_paragraphs:int,publication_date:string>")
    starts = spark.createDataFrame([("p1",), ("q",)], "url string")
    chain = P.follow_pages(starts, pages)
    assert {(r.start_url, r.page_no, r.url) for r in chain.collect()} == {("p1", 1, "p1"), ("p1", 2, "p2"), ("p1", 3, "p3"), ("q", 1, "q")}
    assert P.follow_pages(starts, pages, 2).count() == 3
    whole = {r.url: r for r in P.aggregate_pages(chain, pages, "s").collect()}
    p = whole["p1"]
    assert (p.title, p.num_pages, p.total_paragraphs, p.total_links, p.first_publication_date, p.latest_publication_date) == ("T (Pages 1-3)", 3, 6, 3, "2024-01-01", "2024-02-02")
    assert "--- Page 2 ---" in p.content and whole["q"].title == "Q" and whole["q"].content == "alone"
