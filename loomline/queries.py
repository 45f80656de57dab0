"""The queries of the core operators and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import dates as D
from loomline.functions import html as H
from loomline.functions import text as T
from loomline.operators import chunking, ingest, retrieval, schema_drift, timestamps, vector
from loomline.plans import pipelines
from loomline.session import shared_folder, table
from loomline.sources import documents, pages, store, tools
from loomline.streaming import limits


#: The fixed moment age filters and caches refer to; no query asks a clock.
AS_OF = "2025-06-01 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_lines(F.col("text")).alias("text"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))
    return docs.select("doc_id", F.posexplode_outer(T.sentences(F.col("text"))).alias("n", "sentence")).where("sentence is not null")


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), strategy="fixed")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_documents(table(spark, sf_dir, "documents").select("lang", "text"), strategy="fixed")
    return ingest.length_statistics(chunks, ["lang"])


def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), strategy="sentence")


def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), strategy="paragraph", keep_newlines=True)


def document_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return chunking.with_ordinal(docs, ["doc_id"])


def first_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("intro\n # "), F.coalesce("title", F.lit("?")), F.lit("\n"), "text").alias("text"))
    return docs.select("doc_id", T.first_heading(F.col("text")).alias("heading"))


def route_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "title")
    scores = {f"score_{name}": T.keyword_score(F.col("title"), words) for name, words in T.INTENTS.items()}
    return docs.withColumns({**scores, "intent": T.route(F.coalesce("title", F.lit("")), T.INTENTS)}).drop("title")


def message_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.message_language(F.col("text")).alias("language"))


def message_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.rejection(F.col("text")).alias("rejected"), (F.length("text") > T.LONG_QUERY).alias("long"))


def compose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.truncate(F.col("text")).alias("cut"))


def format_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.array(F.struct("title", "source", "url"), F.struct("title", "source", "url"))
    return table(spark, sf_dir, "documents").select("doc_id", T.format_message(F.col("text"), sources).alias("message"))


def source_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.array(F.struct("title", "source", "url"), F.struct("title", "source", "url"))
    return table(spark, sf_dir, "documents").select("doc_id", T.source_section(sources, "").alias("section"))


def guarded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.guarded(F.col("text"), ["gov", "рада", "council"], "\n--", ["404"], "-")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "page_cache").select(
        "page_id", T.url_host(url).alias("host"), T.cache_key(url).alias("key"), (T.cache_key(url) == F.col("cache_key")).alias("key_fits"),
        T.url_topic(url, T.TOPICS_OFFICIAL).alias("official_topic"), T.url_topic(url, T.TOPICS_COMMUNITY).alias("topic"), T.in_domain(url, "info").alias("in_domain"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "page_cache")
    kept = T.official_first(T.wanted_links(F.col("links"), F.col("url"), T.SKIP_LINKS_OFFICIAL, "visa"))
    return cache.select("page_id", F.posexplode_outer(kept).alias("n", "link")).where("link is not null").select("page_id", "n", "link.text", "link.href", "link.is_official")


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_cache").select(
        "page_id", F.coalesce(F.size("links"), F.lit(0)).alias("n_links"), F.length("content").alias("n_chars"), F.size(F.split("content", "\n", -1)).alias("n_lines")
    )


def cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "page_cache").select("page_id", "url", "scraped_at")
    return pages.fresh(cache, _as_of(), 365 * 86400).select("page_id", pages.age_seconds(F.col("scraped_at"), _as_of()).alias("age"))


def cache_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.expired(table(spark, sf_dir, "page_cache").select("page_id", "scraped_at"), _as_of(), 365 * 86400).select("page_id")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "ingested_docs").select(F.col("metadata.url").alias("url")).where("url is not null").distinct()
    return pages.to_fetch(urls, table(spark, sf_dir, "page_cache").select("url", "scraped_at"), _as_of(), 365 * 86400)


def cache_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.newest_copies(table(spark, sf_dir, "page_cache").select("page_id", "url", "scraped_at", "title")).drop("url")


def pages_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "page_cache")
    return pages.follow_pages(cache.select("url").distinct(), cache)


def pages_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "page_cache")
    return pages.aggregate_pages(pages.follow_pages(cache.select("url").distinct(), cache), cache, "cache").drop("page_urls")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of the cached content and parsed again: title, paragraphs, links."""
    cache = table(spark, sf_dir, "page_cache").where("content is not null")
    lines = F.filter(F.transform(F.split("content", "\n", -1), T.strip), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p> "), H.escaped(x), F.lit("</p>"))), "\n")
    html = F.concat(F.lit("<html><body><nav><p>menu</p></nav><h1>"), H.escaped(F.coalesce("title", F.lit(""))), F.lit("</h1><script>var x = '<p>';</script>"), body, F.lit("<footer>end</footer></body></html>"))
    return cache.select("page_id", H.page(html).alias("p")).select("page_id", "p.title", "p.content", "p.num_paragraphs")


def tool_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rendered as marked-up text and read back."""
    cache = table(spark, sf_dir, "page_cache").where("content is not null and url is not null")
    shown = cache.select("page_id", T.tool_page(F.coalesce("title", F.lit("Untitled")), F.col("url"), F.col("content"), F.col("links")).alias("t"))
    return shown.select("page_id", T.parse_tool_page(F.col("t")).alias("p")).select("page_id", "p.title", "p.url", "p.content")


def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("metadata.document_date")
    return table(spark, sf_dir, "ingested_docs").select(
        "record_id", D.document_date(value).cast("string").alias("moment"), D.display_date(value).alias("shown"),
        D.elapsed_days(D.document_date(value), _as_of()).alias("days"), D.is_recent(value, _as_of(), 365).alias("recent"), D.is_outdated(value, _as_of()).alias("outdated"),
    )


def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "ingested_docs").select("run_id", "record_id", D.document_date(F.col("metadata.document_date")).alias("d"))
    date = F.coalesce("d", F.lit("1970-01-01").cast("timestamp_ntz"))
    return docs.select("run_id", "record_id", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc(date), "record_id")).alias("place"))


def migrated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _as_of().cast("date")
    m = F.col("metadata")
    return table(spark, sf_dir, "ingested_docs").select(
        "record_id", ingest.migrated_date(m["document_date"], m["last_updated"], day).alias("checked"), ingest.migrated_date_unchecked(m["last_updated"]).alias("unchecked"),
        ingest.migrated_date_by_age(m["document_date"], day, 2).alias("by_age"),
    )


def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.migration_counts(table(spark, sf_dir, "ingested_docs").select(F.col("metadata.document_date").alias("document_date")))


def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "raw_records").where(F.try_parse_json("payload").isNotNull())
    at = lambda k: F.get_json_object("payload", f"$.{k}")
    rows = records.select("record_id", at("text").alias("text"), at("content").alias("content"), ingest.first_given(at("metadata.title"), at("title"), F.lit("?")).alias("title"))
    return ingest.normalise_documents(rows)


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "source", "category")
    runs = table(spark, sf_dir, "ingested_docs").select("text", F.col("metadata.source").alias("source"), F.col("metadata.last_updated").alias("last_updated"))
    return ingest.union_sources(docs, runs).groupBy("source_ordinal", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count("category").alias("n_category"), F.count("last_updated").alias("n_updated")
    )


def ingest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("source") == "manual", "manual").alias("document_type"))
    chunks = table(spark, sf_dir, "chunks").select("text", (F.length("text") > 0).alias("stored"))
    return ingest.ingest_statistics(docs, chunks, "startland.example", "mistok.example")


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ingest.consistent_runs(table(spark, sf_dir, "ingest_stats"))
    return runs.groupBy("success").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("documents_loaded").alias("documents"), F.sum("chunks_created").alias("created"), F.sum("chunks_stored").alias("stored"),
        F.round(F.avg("duration_seconds"), 6).alias("seconds"),
    )


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "ingested_docs").select("record_id", "run_id", F.col("metadata.url").alias("url"))
    return ingest.latest(docs, ["url"], ["run_id", "record_id"])


def upsert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "ingested_docs").select("record_id", "run_id", F.col("metadata.url").alias("url")).where("url is not null")
    first = ingest.latest(docs.where("run_id % 2 = 0"), ["url"], ["run_id", "record_id"])
    return ingest.upsert(first, docs.where("run_id % 2 = 1"), ["url"], ["run_id", "record_id"])


def _queries_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = _queries_of(spark, sf_dir)
    return vector.top_k(vectors, queries).withColumn("score", F.round("score", 6))


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = _queries_of(spark, sf_dir)
    return vector.top_k(vectors, queries, equal="label").withColumn("score", F.round("score", 6))


def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = _queries_of(spark, sf_dir)
    return vector.top_k(vectors, queries, k=10, threshold=0.25).withColumn("score", F.round("score", 6))


def vector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.health(table(spark, sf_dir, "embeddings"))


def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector against all; vectors belong to the documents in order of their ids."""
    vectors, queries = _queries_of(spark, sf_dir)
    hits = vector.top_k(vectors, queries).select("query_id", (F.col("vec_id") + 1000).alias("doc_id"), F.round("score", 6).alias("score"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "title", "url", F.date_format("scraped_at", "yyyy-MM-dd").alias("document_date"))
    found = retrieval.retrieve(hits, documents, _as_of(), 900)
    return found.select("query_id", "context", "found_documents", F.round("confidence", 6).alias("confidence"))


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "url", "source", "title")
    return pipelines.index_documents(docs, 64).select("doc_id", "chunk_index", "point_id", F.size("embedding").alias("dimensions"))


def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items as questions to an index of the cached chunks."""
    points = table(spark, sf_dir, "chunks").select(
        F.col("chunk_id").cast("string").alias("point_id"), "text", F.col("metadata.source").alias("source"), F.col("metadata.title").alias("title"), F.col("metadata.url").alias("url"),
        F.col("metadata.scraped_at").alias("document_date"), vector.embed(F.col("text"), 64).alias("embedding"),
    )
    questions = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return pipelines.answer(questions, points, 64, threshold=0.1).select("query_id", "intent", F.round("confidence", 6).alias("confidence"), "reply")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.rate_limit(table(spark, sf_dir, "events"), 5, 86400.0)


def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.throttle(table(spark, sf_dir, "events"))


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 50, "member").otherwise("left").alias("status"))
    return limits.transitions(events, ["user_id"], "status", "event_id").select("user_id", "event_id", "before", "after", "change")


def gated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document titles as group messages, every third one addressed."""
    third = F.col("doc_id") % 3 == 0
    messages = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("user_id"), F.col("scraped_at").alias("ts"), F.concat(F.when(third, "@helper ").otherwise(""), "title").alias("text"), F.lit("group").alias("chat_type"),
        F.lit(False).alias("is_command"), F.lit(False).alias("is_edited"), (F.col("doc_id") % 5 == 0).alias("is_reply"),
    )
    return pipelines.gate_messages(messages, "helper").select("user_id", "question", "rejected", "language")


def _runs_written(spark: SparkSession, sf_dir: str, value, form: str) -> str:
    """A file for each ingest run below a shared folder; the folder."""
    folder = shared_folder(spark, form)
    runs = table(spark, sf_dir, "ingested_docs").groupBy("run_id").agg(value)
    writer = runs.write.partitionBy("run_id")
    writer.option("ignoreNullFields", False).json(folder) if form == "json" else writer.text(folder)
    return folder


def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingested documents written as JSON files, one a run, and scanned."""
    folder = _runs_written(spark, sf_dir, F.collect_list(F.struct("text", "metadata")).alias("documents"), "json")
    return documents.load_documents(spark, folder, "json", as_of=AS_OF).select("text", "source", "title", "url", "category", "language", "last_updated", "scraped_at", "document_type")


def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _runs_written(spark, sf_dir, F.max(F.coalesce("text", F.lit(""))).alias("value"), "text")
    return documents.load_documents(spark, folder, "txt", as_of=AS_OF).select("text", "source", "type", "scraped_at")


def scan_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("first line\n# Run "), F.min("record_id").cast("string"), F.lit(" \n"), F.max(F.coalesce("text", F.lit(""))))
    folder = _runs_written(spark, sf_dir, body.alias("value"), "markdown")
    return documents.load_documents(spark, folder, "markdown", as_of=AS_OF, pattern="*.txt").select("title", "text", "type")


def migrated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of documents migrated, written to the active folder and read back."""
    archive = table(spark, sf_dir, "ingested_docs").where("text is not null").select("record_id", "text", "metadata.document_date", "metadata.last_updated")
    folder = shared_folder(spark, "active")
    documents.write_documents(ingest.migrated_documents(archive, _as_of().cast("date")), folder)
    return documents.read_written(spark, folder).select("record_id", "text", "document_date")


def official_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached content as the main column of an official page, read with that site's profile."""
    cache = table(spark, sf_dir, "page_cache").where("content is not null")
    lines = F.filter(F.transform(F.split("content", "\n", -1), T.strip), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), H.escaped(x), F.lit("</p>"))), "")
    html = F.concat(F.lit("<html><body><header><p>a long line of the header of the site</p></header><h1>"), H.escaped(F.coalesce("title", F.lit(""))), F.lit(f"</h1><div class='x {H.OFFICIAL.containers[0][1:]}'>"), body, F.lit("<ul><li>an item of the list<li>short</ul></div><p>a long line beside the main column</p></body></html>"))
    return cache.select("page_id", H.page(html, F.lit("https://a.example/"), H.OFFICIAL).alias("p")).select("page_id", "p.title", "p.content", "p.num_paragraphs")


def community_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached content in the container of a community page, read whole."""
    cache = table(spark, sf_dir, "page_cache").where("content is not null")
    html = F.concat(F.lit("<body><nav>menu</nav><div class='content'><aside>aside</aside>"), H.escaped(F.col("content")), F.lit("</div>outside</body>"))
    return cache.select("page_id", H.page(html, None, H.COMMUNITY_WHOLE).alias("p")).where("p.content is not null").select("page_id", "p.content", "p.content_length")


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "page_cache").select("url").where("url is not null").distinct()
    rules = urls.select(T.url_host(F.col("url")).alias("host")).where("length(host) % 2 = 0").distinct()
    rules = rules.withColumn("text", F.lit("User-agent: *\nDisallow: /housing\nDisallow: /visas\n"))
    return pages.allowed(urls, rules)


def _canned(url: str) -> str | None:
    """A page made of its address; addresses of an even length have none."""
    return f"<h1>Page</h1><p>{len(url)} letters</p><a href='/on'>on</a>" if len(url) % 2 else None


def _fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    urls = table(spark, sf_dir, "ingested_docs").select(F.col("metadata.url").alias("url"))
    cache = table(spark, sf_dir, "page_cache")
    return cache, pages.fetch_pages(urls, cache, _canned, _as_of(), {}, ttl=365 * 86400, retries=1)


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of the ingested documents from the cache, or from a canned site."""
    return _fetched(spark, sf_dir)[1].select("url", "title", "cached", "scraped_at", F.size("links").alias("n_links"), "error")


def cache_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, read = _fetched(spark, sf_dir)
    return pages.merged_cache(cache, read, _as_of(), 365 * 86400).select("cache_key", "url", "scraped_at", "title")


def topic_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.col("category")
    return table(spark, sf_dir, "documents").select(
        "doc_id", tools.OFFICIAL_HOUSING.path_column(topic).alias("official_housing"), tools.OFFICIAL_HEALTH.path_column(F.lit("GP")).alias("official_health"),
        tools.COMMUNITY_HEALTH.path_column(topic).alias("community_health"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the cache by the path tool of its site, and a call without its parameter."""
    cache = table(spark, sf_dir, "page_cache")
    first = cache.agg(F.min("url")).first()[0]
    root = "/".join(first.split("/")[:3])
    known = tools.site_tools(root, root)
    found = tools.call(cache, "official_page", {"path": first[len(root) :]}, known)
    return found.unionByName(tools.call(cache, "community_page", {}, known)).unionByName(tools.call(cache, "none", {}, known))


def scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    page = T.scraped_page(
        F.coalesce("title", F.lit("Untitled")), F.col("url"), F.col("scraped_at").try_cast("timestamp_ntz"), F.col("cached"), m["publication_date"], F.col("content"), F.col("links"),
        m["content_length"], m["num_links"], T.in_domain(F.col("url"), "info"),
    )
    return table(spark, sf_dir, "page_cache").where("url is not null").select("page_id", page.alias("page"))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.linked(table(spark, sf_dir, "page_cache"))


def search_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("q"), (F.col("doc_id") % 4).alias("found"))
    return docs.select("doc_id", T.needs_search(F.col("q"), F.col("found")).alias("needed"), T.search_subject(F.col("q")).alias("subject"))


def chunk_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunk_documents(docs, strategy="fixed", order=["doc_id"]).select("doc_id", "document_index", "chunk_index", "total_chunks")


def collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors put into a collection in two batches, every 50th searched for."""
    vectors, queries = _queries_of(spark, sf_dir)
    points = vectors.select(F.col("vec_id").alias("point_id"), "embedding", F.lit("t").alias("text"), "label")
    collection = store.Collection(spark, shared_folder(spark, "collection"), 8)
    collection.create(vectors.select(F.size("embedding")).first()[0])
    collection.upsert(points.where("point_id % 3 <> 0").withColumn("label", F.lit(-1)))
    collection.upsert(points.where("point_id % 3 <> 1 or point_id % 2 = 0"))
    collection.upsert(points.where("point_id % 3 = 1 and point_id % 2 = 1"))
    found = collection.search(queries, threshold=None)
    return found.join(collection.points().select("point_id", "label"), "point_id").select("query_id", "point_id", F.round("score", 6).alias("score"), "rank", "label")


def message_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document titles as private messages of a hundred users, answered from the cached chunks."""
    points = table(spark, sf_dir, "chunks").select(F.col("chunk_id").cast("string").alias("point_id"), "text", F.col("metadata.source").alias("source"), vector.embed(F.col("text"), 64).alias("embedding"))
    messages = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("message_id"), (F.col("doc_id") % 100).alias("user_id"), F.col("scraped_at").alias("ts"), F.coalesce("title", F.lit(" ")).alias("text"), F.lit("private").alias("chat_type"),
        F.lit(False).alias("is_command"), (F.col("doc_id") % 7 == 0).alias("is_edited"), F.lit(False).alias("is_reply"),
    )
    replies = pipelines.reply_messages(messages, points, "helper", 64, limit=2, window=30 * 86400.0, threshold=0.1)
    return replies.select("message_id", "user_id", "status", "language", "question", "intent")


def scraped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of the page cache read from a canned site, those without a page left out."""
    return pages.scrape(table(spark, sf_dir, "page_cache").select("url"), _canned, topic=lambda u: T.url_topic(u, T.TOPICS_COMMUNITY), retries=1).select("url", "title", "text", "topic")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as questions with the document, a page or nothing as context."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("q"), F.when(F.col("doc_id") % 3 != 0, F.substring("text", 1, 80)).alias("base"), F.when(F.col("doc_id") % 2 == 0, F.col("url")).alias("url"))
    context = T.joined_contexts(F.col("base"), F.col("url"), F.col("q"), F.col("url"), "BASE", "WEB")
    return docs.withColumn("context", context).select("doc_id", "context", T.prompt(F.col("q"), F.col("context"), "Q {query} C {context}", "only {query}").alias("prompt"))


def next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the weekly run after each ingest run is due."""
    moment = F.col("run_timestamp").try_cast("timestamp_ntz")
    return table(spark, sf_dir, "ingest_stats").where(moment.isNotNull()).select("run_id", D.next_weekly(moment).cast("string").alias("due"))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "ingested_docs")
    pages = table(spark, sf_dir, "page_cache")
    return timestamps.readable(
        [
            timestamps.stated_times(docs, "ingested_docs", "record_id", {"last_updated": "metadata.last_updated", "scraped_at": "metadata.scraped_at"}),
            timestamps.stated_times(pages, "page_cache", "page_id", {"publication_date": "metadata.publication_date"}),
        ]
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).drop("status")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).groupBy("rec_table", "field", "status").agg(
        F.count(F.lit(1)).alias("n"), F.min("utc").alias("first"), F.max("utc").alias("last")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf_dir, "raw_records")).select("file_name", "change", "field", "old_field")


def p7_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, sf_dir, "raw_records"))


#: Queries whose rows every SQL engine can give, and those tested against brute force instead.
CORE = (
    clean_text, clean_lines, sentences, chunk_fixed, chunk_stats, chunk_sentence, chunk_paragraph, document_ordinal, first_heading, route_intent, message_language,
    message_gate, compose_text, format_message, source_section, guarded_text, url_parts, page_links, page_counts, cache_fresh, cache_expired, cache_misses, cache_newest,
    pages_followed, pages_aggregated, html_pages, tool_pages, document_dates, date_order, migrated_dates, migration_counts, normalised_records, union_sources,
    ingest_statistics, run_statistics, upsert_latest, upsert_runs, vector_topk, vector_topk_filtered, vector_threshold, vector_health, retrieve_context, index_chunks,
    answer_questions, rate_limit, throttle, status_changes, gated_messages, scan_json, scan_text, scan_markdown, migrated_documents, official_pages, community_pages,
    robots_allowed, fetched_pages, cache_merged, topic_paths, tool_calls, scraped_pages, linked_pages, search_triggers, chunk_ordinals, collection_search, message_replies,
    scraped_documents, prompts, next_runs,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*CORE, p5_found, p5_report, p7_found, p7_table)}

# The SQL stands in a module of its own.
from loomline.oracle import ORACLE  # noqa: E402, F401
