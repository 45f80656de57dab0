"""Named page tools over a page table: look-up by section or address, with declared parameters.

Tools are data: a name, a description, the parameters, and a function from the page table and
the parameters to rows. An unknown tool or a missing parameter gives an error row, never an
exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T

#: Links that lead to pages for search, not for readers.
EXCLUDED = ["login", "admin", "wp-", "feed", "comment", "tag", "author"]
TOPIC_WORDS = ["ukraine", "sponsor", "refugee", "asylum"]


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable[..., DataFrame]
    required: tuple[str, ...] = ()
    optional: dict = field(default_factory=dict, hash=False)

    def schema(self) -> dict:
        names = {**{n: {"type": "string"} for n in self.required}, **{n: {"type": "string", "default": v} for n, v in self.optional.items()}}
        return {"type": "object", "properties": names, "required": list(self.required)}


def by_url(pages: DataFrame, url: str) -> DataFrame:
    return pages.where(F.col("url") == url)


def by_section(pages: DataFrame, section: str, host: str = "") -> DataFrame:
    """Pages whose path begins with a section."""
    path = F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)?", 1)
    found = pages.where(path.startswith("/" + section.strip("/")))
    return found.where(T.in_domain(F.col("url"), host)) if host else found


def linked(pages: DataFrame, words: list[str] | None = None, host: str | None = None, excluded: list[str] = EXCLUDED) -> DataFrame:
    """Distinct absolute links of the pages: on a host, with one of the words in text or address, without the excluded."""
    links = pages.select(F.col("url").alias("from_url"), F.explode_outer(T.wanted_links(F.col("links"), F.col("url"))).alias("x")).where("x is not null")
    out = links.select("x.text", F.col("x.href").alias("url")).where(~T.mentions_any(F.col("url"), excluded))
    if host:
        out = out.where(T.in_domain(F.col("url"), host))
    if words:
        out = out.where(T.mentions_any(F.col("url"), words) | T.mentions_any(F.col("text"), words))
    return out.select("url").distinct()


@dataclass(frozen=True)
class Topics:
    """Where the pages of a subject stand on a site: the page without a topic, topics with a path of their own, the pattern of the others."""

    default: str
    pattern: str
    known: dict = field(default_factory=dict, hash=False)

    def path(self, topic: str | None) -> str:
        if not topic:
            return self.default
        return topic if topic.startswith("/") else self.known.get(topic.lower(), self.pattern.format(topic))

    def path_column(self, topic: Column) -> Column:
        before, after = self.pattern.split("{}")
        known = F.create_map(*[F.lit(x) for kv in self.known.items() for x in kv]) if self.known else F.lit(None).cast("map<string,string>")
        other = F.concat(F.lit(before), topic, F.lit(after))
        return F.when(F.coalesce(topic, F.lit("")) == "", self.default).when(topic.startswith("/"), topic).otherwise(F.coalesce(F.try_element_at(known, F.lower(topic)), other))


#: The paths of the official site's subjects, and of the community site's.
OFFICIAL_HOUSING = Topics("/housing-for-ukraine", "/housing/{}", {
    "ukraine": "/housing-for-ukraine", "council": "/council-housing", "renting": "/private-renting", "benefit": "/housing-benefit", "homeless": "/homelessness",
})
OFFICIAL_HEALTH = Topics("/nhs-services", "/nhs/{}", {"gp": "/register-with-a-gp", "services": "/nhs-services", "emergency": "/emergency-medical-treatment"})
OFFICIAL_SCHEME = Topics("/housing-for-ukraine", "/housing-for-ukraine")
COMMUNITY_HOUSING, COMMUNITY_HEALTH = Topics("/housing", "/housing/{}"), Topics("/nhs", "/nhs/{}")


def by_topic(base: str, topics: Topics) -> Callable[..., DataFrame]:
    """The page of a topic on the site at ``base``."""
    return lambda pages, topic="": by_url(pages, base.rstrip("/") + topics.path(topic))


def by_path(base: str) -> Callable[..., DataFrame]:
    return lambda pages, path: by_url(pages, base.rstrip("/") + (path if path.startswith("/") else "/" + path))


def site_tools(official: str, community: str) -> dict[str, Tool]:
    """The page tools of two sites: housing, health and any page of both, and the scheme page of the official one."""
    topic = {"topic": ""}
    return {
        t.name: t
        for t in (
            Tool("community_housing", "The community site's page on housing, or a topic of it", by_topic(community, COMMUNITY_HOUSING), (), topic),
            Tool("community_health", "The community site's page on health care, or a topic of it", by_topic(community, COMMUNITY_HEALTH), (), topic),
            Tool("community_page", "A page of the community site by its path", by_path(community), ("path",)),
            Tool("official_housing", "The official page on housing, or a topic of it", by_topic(official, OFFICIAL_HOUSING), (), topic),
            Tool("official_health", "The official page on health care, or a topic of it", by_topic(official, OFFICIAL_HEALTH), (), topic),
            Tool("official_scheme", "The official page on the accommodation scheme", by_topic(official, OFFICIAL_SCHEME)),
            Tool("official_page", "An official page by its path", by_path(official), ("path",)),
        )
    }


TOOLS = {
    t.name: t
    for t in (
        Tool("get_page", "One page by its address", by_url, ("url",)),
        Tool("get_section", "Pages of a section", by_section, ("section",), {"host": ""}),
    )
}


def call(pages: DataFrame, name: str, arguments: dict, tools: dict[str, Tool] = TOOLS) -> DataFrame:
    """(page, error): pages as marked-up text, or one row with the error."""
    spark = pages.sparkSession
    schema = "page string, error string"
    tool = tools.get(name)
    if tool is None:
        return spark.createDataFrame([(None, f"Unknown tool: {name}")], schema)
    missing = [n for n in tool.required if not arguments.get(n)]
    if missing:
        return spark.createDataFrame([(None, f"Missing parameter: {missing[0]}")], schema)
    known = {**tool.optional, **{k: v for k, v in arguments.items() if k in tool.required or k in tool.optional}}
    found = tool.run(pages, **known)
    shown = T.tool_page(F.coalesce("title", F.lit("Untitled")), F.col("url"), F.coalesce("content", F.lit("")), F.col("links"))
    return found.select(shown.alias("page"), F.lit(None).cast("string").alias("error"))
