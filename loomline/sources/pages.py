"""Web pages: cache with a time to live, robots rules, fetching, pagination, page aggregation.

Fetching is a function passed in (URL to HTML or None), run in map tasks with retries; the
rest works on tables of pages, so that everything but the network is tested offline.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import html as H
from loomline.functions.text import cache_key, next_page, url_host

TTL_SECONDS, MOST_PAGES, RETRIES = 24 * 3600, 5, 3


def age_seconds(scraped_at: Column, as_of: Column) -> Column:
    return F.timestamp_diff("SECOND", scraped_at.try_cast("timestamp_ntz"), as_of)


def fresh(cache: DataFrame, as_of: Column, ttl: int = TTL_SECONDS, scraped_at: str = "scraped_at") -> DataFrame:
    """Cached pages not older than the time to live; those without a readable time are stale."""
    return cache.where(age_seconds(F.col(scraped_at), as_of) <= ttl)


def expired(cache: DataFrame, as_of: Column, ttl: int = TTL_SECONDS, scraped_at: str = "scraped_at") -> DataFrame:
    return cache.where(~F.coalesce(age_seconds(F.col(scraped_at), as_of) <= ttl, F.lit(False)))


def to_fetch(urls: DataFrame, cache: DataFrame, as_of: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """URLs without a fresh copy in the cache (an anti join on the key)."""
    known = fresh(cache, as_of, ttl).select(cache_key(F.col("url")).alias("__key"))
    return urls.withColumn("__key", cache_key(F.col("url"))).join(known, "__key", "left_anti").drop("__key")


def newest_copies(cache: DataFrame) -> DataFrame:
    """One row a cache key: the page scraped last, then of the highest id."""
    best = cache.groupBy(cache_key(F.col("url")).alias("key")).agg(F.max_by(F.struct(*cache.columns), F.struct("scraped_at", "page_id")).alias("r"), F.count(F.lit(1)).alias("n_copies"))
    return best.select("key", "n_copies", "r.*")


def one_copy(pages: DataFrame) -> DataFrame:
    """One row a URL, always the same: the last copy by time and id, or by all columns where there are none."""
    order = [c for c in ("scraped_at", "page_id") if c in pages.columns] or pages.columns
    return pages.groupBy("url").agg(F.max_by(F.struct(*pages.columns), F.struct(*order)).alias("__r")).select("__r.*")


def robots_rules(urls: DataFrame, known: DataFrame, get: Callable[[str], str | None], as_of: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """(host, text, fetched_at): the rules of each host; those known for no longer than the time to live are not fetched again.

    A host whose rules cannot be fetched has a null text, which allows everything.
    """
    hosts = urls.select(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1).alias("root"), url_host(F.col("url")).alias("host")).where("host is not null")
    hosts = hosts.groupBy("host").agg(F.min("root").alias("root"))
    valid = known.where(age_seconds(F.col("fetched_at"), as_of) <= ttl).select("host", "text", "fetched_at")
    missing = hosts.join(valid, "host", "left_anti").select("host", F.concat("root", F.lit("/robots.txt")).alias("url"))
    got = fetch(missing, get, retries=1).select("url", F.col("html").alias("text"))
    fetched = missing.join(got, "url").select("host", "text", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"))
    return hosts.select("host").join(valid, "host").unionByName(fetched)


def allowed(urls: DataFrame, robots: DataFrame | dict[str, str], agent: str = "*") -> DataFrame:
    """URLs the robots rules of their host allow, rules being (host, text). Hosts without rules allow everything."""
    if isinstance(robots, dict):
        robots = urls.sparkSession.createDataFrame(list(robots.items()), "host string, text string")
    rules = robots.groupBy(F.col("host").alias("__host")).agg(F.max("text").alias("__rules"))

    @F.pandas_udf("boolean")
    def may(texts: pd.Series, links: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for text, url in zip(texts, links):
            if not isinstance(text, str) or not isinstance(url, str):
                out.append(True)
                continue
            if text not in parsed:
                parsed[text] = RobotFileParser()
                parsed[text].parse(text.splitlines())
            out.append(parsed[text].can_fetch(agent, url))
        return pd.Series(out, dtype=bool)

    return urls.join(rules, url_host(F.col("url")) == F.col("__host"), "left").where(may(F.col("__rules"), F.col("url"))).drop("__host", "__rules")


def fetch(urls: DataFrame, get: Callable[[str], str | None], retries: int = RETRIES, pause: Callable[[int], float] = lambda n: 2.0 * (n + 1)) -> DataFrame:
    """(url, html, error): each URL fetched, up to ``retries`` times; one that fails is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                html, error = None, None
                for n in range(retries):
                    try:
                        html, error = get(url), None
                        if html is not None:
                            break
                        error = "no content"
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                    if n + 1 < retries:
                        time.sleep(pause(n))
                rows.append((url, html, error))
            yield pd.DataFrame(rows, columns=["url", "html", "error"], dtype=object)

    return urls.select("url").distinct().mapInPandas(run, "url string, html string, error string")


def fetch_pages(
    urls: DataFrame, cache: DataFrame, get: Callable[[str], str | None], as_of: Column, robots: DataFrame | dict[str, str] | None = None, profile: H.Profile = H.GENERIC,
    ttl: int = TTL_SECONDS, **options,
) -> DataFrame:
    """(url, title, content, links, scraped_at, cached, error): each distinct URL from the cache if it is fresh there, else fetched and parsed if allowed.

    The cache holds (page_id, url, title, content, links, scraped_at). A page that may not be
    fetched has the error ``disallowed``, one without content ``no content``.
    """
    wanted = urls.select("url").where("url is not null").distinct()
    columns = ("url", "title", "content", "links", "scraped_at")
    held = one_copy(fresh(cache.select("page_id", *columns), as_of, ttl)).select(*columns)
    hits = wanted.join(held, "url").withColumns({"cached": F.lit(True), "error": F.lit(None).cast("string")})
    misses = wanted.join(held.select("url"), "url", "left_anti")
    may = misses if robots is None else allowed(misses, robots)
    read = fetch(may, get, **options).withColumn("p", H.page(F.col("html"), F.col("url"), profile))
    links = held.schema["links"].dataType
    got = read.select(
        "url", "p.title", "p.content", F.col("p.links").cast(links).alias("links"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("scraped_at"), F.lit(False).alias("cached"),
        F.coalesce("error", F.when(F.col("p.content").isNull(), "no content")).alias("error"),
    )
    out = hits.unionByName(got)
    if robots is not None:
        out = out.unionByName(misses.join(may, "url", "left_anti").withColumns({"cached": F.lit(False), "error": F.lit("disallowed")}), allowMissingColumns=True)
    return out


def scrape(urls: DataFrame, get: Callable[[str], str | None], profile: H.Profile = H.GENERIC, topic: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """(url, title, text, language, description, document_date, topic): each distinct URL read and parsed; pages that fail or have no content are left out.

    ``options`` are those of ``fetch``; one URL's failure leaves the others alone.
    """
    read = fetch(urls.where("url is not null"), get, **options).where("html is not null").withColumn("p", H.page(F.col("html"), F.col("url"), profile))
    named = topic(F.col("url")) if topic else F.lit(None).cast("string")
    return read.where("p.content <> ''").select(
        "url", "p.title", F.col("p.content").alias("text"), "p.language", "p.description", F.col("p.publication_date").alias("document_date"), named.alias("topic")
    )


def merged_cache(cache: DataFrame, pages: DataFrame, as_of: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """The cache with newly read pages put over it, and without what has outlived the time to live; one row a key."""
    new = pages.where("not cached and error is null").withColumn("cache_key", cache_key(F.col("url"))).drop("cached", "error")
    old = one_copy(cache).withColumn("cache_key", cache_key(F.col("url")))
    kept = fresh(old, as_of, ttl).join(new.select("cache_key"), "cache_key", "left_anti")
    return kept.select(*[c for c in new.columns]).unionByName(new)


def follow_pages(starts: DataFrame, pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(start_url, page_no, url): from each start along the next-page links, at most ``most`` pages, no page twice.

    ``most`` joins on the URL; each step only carries the open chains.
    """
    links = one_copy(pages).select("url", next_page(F.col("links"), F.col("url")).alias("next_url"))
    step = starts.select(F.col("url").alias("start_url"), "url", F.array("url").alias("seen"), F.lit(1).alias("page_no")).distinct()
    step = step.join(links, "url", "left")
    out = step.select("start_url", "page_no", "url")
    for k in range(2, most + 1):
        ahead = step.where(F.col("next_url").isNotNull() & ~F.array_contains("seen", F.col("next_url")))
        step = ahead.select("start_url", F.col("next_url").alias("url"), F.concat("seen", F.array("next_url")).alias("seen"), F.lit(k).alias("page_no")).join(links, "url")
        out = out.unionByName(step.select("start_url", "page_no", "url"))
    return out


def aggregate_pages(chain: DataFrame, pages: DataFrame, source: str) -> DataFrame:
    """Each chain as one page: contents joined with page marks, distinct links, sums, first and last date. Chains are bounded by ``follow_pages``."""
    page = one_copy(pages).select(
        "url", "title", "content", "links", F.col("metadata.num_paragraphs").alias("num_paragraphs"), F.col("metadata.publication_date").alias("publication_date")
    )
    rows = chain.join(page, "url")
    item = F.struct("page_no", "url", "title", "content", "links", "num_paragraphs", "publication_date")
    grouped = rows.groupBy("start_url").agg(F.array_sort(F.collect_list(item)).alias("p"))
    n = F.size("p")
    marked = F.transform("p", lambda x, k: F.when(k == 0, x["content"]).otherwise(F.concat(F.lit("\n\n--- Page "), (k + 1).cast("string"), F.lit(" ---\n\n"), x["content"])))
    content = F.array_join(marked, "\n")
    links = F.flatten(F.transform("p", lambda x: x["links"]))
    targets = F.transform(links, lambda x: x["href"])
    distinct = F.filter(F.transform(links, lambda x, k: F.when(F.array_position(targets, x["href"]) == k + 1, x)), lambda x: x.isNotNull())
    dates = F.filter(F.transform("p", lambda x: x["publication_date"]), lambda d: F.coalesce(d, F.lit("")) != "")
    title = F.col("p")[0]["title"]
    return grouped.select(
        F.col("start_url").alias("url"),
        F.when(n == 1, title).otherwise(F.concat(title, F.lit(" (Pages 1-"), n.cast("string"), F.lit(")"))).alias("title"),
        content.alias("content"),
        n.alias("num_pages"),
        F.transform("p", lambda x: x["url"]).alias("page_urls"),
        F.aggregate("p", F.lit(0), lambda s, x: s + F.coalesce(x["num_paragraphs"], F.lit(0))).alias("total_paragraphs"),
        F.size(distinct).alias("total_links"),
        F.length(content).alias("content_length"),
        F.try_element_at(dates, F.lit(1)).alias("first_publication_date"),
        F.try_element_at(dates, F.lit(-1)).alias("latest_publication_date"),
        F.lit(source).alias("source"),
    )
