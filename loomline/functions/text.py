"""Text functions: Column in, Column out, all native.

Nulls give null unless said otherwise. White space is Unicode white space with the file,
group, record and unit separators (U+001C-U+001F).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"(?U)[\s\u001c-\u001f]+"
_ENDS = r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$"


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, _ENDS, "")


def clean_text(text: Column) -> Column:
    """One space for each run of white space, no control characters, no white space at the ends."""
    spaced = F.regexp_replace(text, _WHITE, " ")
    return F.trim(F.regexp_replace(spaced, r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]", ""))


def clean_lines(text: Column) -> Column:
    """Every line stripped, blank lines dropped."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def first_heading(text: Column) -> Column:
    """The first line that is a level-one heading, without its mark; null if there is none."""
    found = F.regexp_extract(text, r"(?m)^[ \t]*# (.*)$", 1)
    return F.when(text.rlike(r"(?m)^[ \t]*# "), strip(found))


def title_from_name(name: Column) -> Column:
    """A title from a file name: no suffix, separators as spaces, words capitalised."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.initcap(F.translate(stem, "_-", "  "))


def sentences(text: Column) -> Column:
    """Sentences: cut at white space between an end mark and a Ukrainian or Latin capital; blank ones dropped."""
    parts = F.transform(F.split(text, "(?U)(?<=[.!?…])[\\s\\u001c-\\u001f]+(?=[А-ЯІЇЄҐA-Z])", -1), strip)
    return F.filter(parts, lambda s: s != "")


# Keyword routing.

#: Stems that route a question; an entry listed twice counts twice.
INTENTS = {
    "visa": ["віз", "дозвіл", "upe", "brp", "подорож", "імігр", "поїздк", "виїзд", "в'їзд", "прикордон", "паспорт", "документ",
             "виз", "разреш", "поездк", "въезд", "выезд", "границ", "паспорт"],
    "housing": ["житл", "оренд", "nhs", "gp", "школ", "лікар", "медиц", "квартир", "будин", "реєстр", "дит", "освіт", "лікарн",
                "жиль", "аренд", "квартир", "врач", "школ", "медиц", "больниц", "регистр"],
    "work": ["робот", "зарплат", "ni number", "national insurance", "benefits", "допомог", "працевлашт", "податк", "universal credit", "заробіт",
             "вакансі", "роботодав", "работ", "зарплат", "пособ", "помощ", "налог", "вакансии"],
}


def keyword_score(text: Column, words: list[str]) -> Column:
    """How many entries of a list stand in the lower-case text."""
    low = F.lower(text)
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.contains(low, F.lit(w)), 1).otherwise(0)
    return F.coalesce(total, F.lit(0))


def route(text: Column, lists: dict[str, list[str]], least: int = 1, otherwise: str = "uncertain") -> Column:
    """The list with the highest score, the first of equals; ``otherwise`` below ``least``."""
    scores = {name: keyword_score(text, words) for name, words in lists.items()}
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(best < least, otherwise)
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out


def mentions_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the lower-case text."""
    return keyword_score(text, words) > 0


# Language of a short message, by letters, then words, then script.

#: Fixed values.
UKRAINIAN_LETTERS, RUSSIAN_LETTERS = "ґєії", "ыэъё"
UKRAINIAN_WORDS = ["як", "що", "де", "коли", "чому", "який", "яка", "які", "ви", "ти", "він", "вона", "вони", "ми", "я", "дякую", "вітаю", "привіт",
                   "може", "можу", "треба", "потрібно", "допоможіть", "допомогти", "зробити", "отримати"]
RUSSIAN_WORDS = ["как", "что", "где", "когда", "почему", "который", "которая", "которые", "вы", "ты", "он", "она", "они", "мы", "я", "спасибо",
                 "пожалуйста", "привет", "может", "могу", "нужно", "надо", "помогите", "помочь", "сделать", "получить"]


def cyrillic_share(text: Column) -> Column:
    """Cyrillic characters by letters; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^Ѐ-ӿ]+", "")) / letters)


def message_language(text: Column) -> Column:
    """uk, ru or unknown."""
    low = F.lower(text)
    uk, ru = low.rlike(f"[{UKRAINIAN_LETTERS}]"), low.rlike(f"[{RUSSIAN_LETTERS}]")
    words = F.regexp_extract_all(low, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    n_uk = F.size(F.filter(words, lambda w: w.isin(UKRAINIAN_WORDS)))
    n_ru = F.size(F.filter(words, lambda w: w.isin(RUSSIAN_WORDS)))
    return (
        F.when(text.isNull() | (strip(text) == ""), "unknown")
        .when(uk & ~ru, "uk")
        .when(ru & ~uk, "ru")
        .when(n_uk > n_ru, "uk")
        .when(n_ru > n_uk, "ru")
        .when(cyrillic_share(text) > 0.5, "uk")
        .otherwise("unknown")
    )


# Message gates.

#: Patterns of unwanted messages, on lower-case text.
SPAM = [r"(buy|cheap|discount|sale|offer).*\$\d+", r"click here.*http", r"http://bit\.ly", r"free money", r"win \$", r"urgent.*click"]
LONGEST_MESSAGE, LONG_QUERY = 4096, 500


def is_spam(text: Column, patterns: list[str] = SPAM) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in patterns:
        out = out | low.rlike("(?d)" + p)
    return F.coalesce(out, F.lit(False))


def rejection(text: Column) -> Column:
    """Why a message is not let through: spam_detected, message_too_long, empty_message, or '' if it is."""
    return (
        F.when(is_spam(text), "spam_detected")
        .when(F.length(text) > LONGEST_MESSAGE, "message_too_long")
        .when(text.isNull() | (strip(text) == ""), "empty_message")
        .otherwise("")
    )


def addressed(text: Column, name: str, is_reply: Column) -> Column:
    """Whether a group message mentions the account or answers it."""
    return F.coalesce(F.contains(text, F.lit(f"@{name}")), F.lit(False)) | F.coalesce(is_reply, F.lit(False))


def without_mention(text: Column, name: str) -> Column:
    return strip(F.replace(text, F.lit(f"@{name}"), F.lit("")))


# URLs and links.

#: The first rule whose part stands in the lower-case URL names the topic.
TOPICS_OFFICIAL = [("visa", ["visa", "family-scheme"]), ("housing", ["homes-for-ukraine", "sponsor"]), ("benefits", ["cost-of-living", "support"]),
                   ("work", ["work", "employment"])]
TOPICS_COMMUNITY = [
    ("visa", ["visa", "імміграц"]), ("housing", ["housing", "житл"]), ("work", ["work", "робот", "employment"]), ("benefits", ["benefits", "допомог"]),
    ("healthcare", ["healthcare", "nhs", "здоров"]), ("education", ["education", "освіт", "school"]), ("legal", ["legal", "юридич"]),
]
#: Parts of links that lead nowhere of use.
SKIP_LINKS = ["#", "javascript:", "mailto:", "tel:", "facebook.com", "twitter.com", "instagram.com"]
SKIP_LINKS_OFFICIAL = ["#", "javascript:", "mailto:", "tel:", "/help/", "/contact", "/feedback", "facebook.com", "twitter.com", "youtube.com"]
NEXT_PAGE = ["наступна", "далі", "next", "следующая", "→", "»", "newer", "новіші"]


def url_topic(url: Column, rules: list[tuple[str, list[str]]], otherwise: str = "general") -> Column:
    low = F.lower(url)
    out = F.when(url.isNull(), None)
    for topic, parts in rules:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        out = out.when(hit, topic)
    return out.otherwise(otherwise)


def url_host(url: Column) -> Column:
    """The host of a URL without its port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def in_domain(url: Column, domain: str) -> Column:
    return F.coalesce(F.contains(url_host(url), F.lit(domain)), F.lit(False))


def cache_key(url: Column) -> Column:
    return F.md5(url)


def absolute_link(base: Column, href: Column) -> Column:
    """A root-relative link completed with the scheme and host of its page."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return F.when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(href)


def wanted_links(links: Column, base: Column, skip: list[str] = SKIP_LINKS, official: str | None = None) -> Column:
    """Links with text, absolute, the first of each target, none of the skipped; with ``is_official`` if a domain is given."""
    full = F.transform(links, lambda x: F.struct(strip(x["text"]).alias("text"), absolute_link(base, x["href"]).alias("href")))
    useful = F.filter(full, lambda x: (F.coalesce(x["text"], F.lit("")) != "") & (F.coalesce(x["href"], F.lit("")) != ""))
    useful = F.filter(useful, lambda x: ~mentions_any(x["href"], skip))
    targets = F.transform(useful, lambda x: x["href"])
    # keep a link whose target stands at its place for the first time
    first = F.filter(F.transform(useful, lambda x, k: F.when(F.array_position(targets, x["href"]) == k + 1, x)), lambda x: x.isNotNull())
    if official is None:
        return first
    return F.transform(first, lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href"), F.contains(F.lower(x["href"]), F.lit(official)).alias("is_official")))


def official_first(links: Column) -> Column:
    """Official links first, then by text."""
    keyed = F.transform(links, lambda x: F.struct((~x["is_official"]).alias("a"), x["text"].alias("text"), x["href"].alias("href"), x["is_official"].alias("is_official")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href"), x["is_official"].alias("is_official")))


def next_page(links: Column, url: Column, words: list[str] = NEXT_PAGE) -> Column:
    """The target of the first link that leads to the next page: by its text, or another URL with "page" in it."""

    def leads(x: Column) -> Column:
        low = F.lower(x["text"])
        hit = F.contains(F.lower(x["href"]), F.lit("page")) & (x["href"] != url)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        return hit

    return F.try_element_at(F.filter(links, leads), F.lit(1))["href"]


def wanted_paragraphs(paragraphs: Column, least: int = 20, phrases: tuple[str, ...] = ()) -> Column:
    """Paragraphs of at least so many characters without one of the phrases."""
    out = F.filter(paragraphs, lambda p: F.length(p) >= least)
    return F.filter(out, lambda p: ~mentions_any(p, list(phrases))) if phrases else out


# Composing text.


def snippet(text: Column, length: int = 200) -> Column:
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def truncate(text: Column, limit: int = 3800, notice: str = "\n\n...(повідомлення скорочено через обмеження довжини)", fill: float = 0.8) -> Column:
    """Cut behind the last full stop or line end before the limit if it fills enough of it, else at the limit, with a notice."""
    head = F.substring(text, 1, limit)
    back = F.reverse(head)
    dot, line = F.instr(back, "."), F.instr(back, "\n")
    last = F.greatest(F.when(dot > 0, limit - dot).otherwise(-1), F.when(line > 0, limit - line).otherwise(-1))
    point = F.when(last > limit * fill, last + 1).otherwise(limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), point), F.lit(notice)))


def escape_marks(text: Column) -> Column:
    """Lone underscores and asterisks, and brackets that are no link, escaped."""
    out = F.regexp_replace(text, r"(?U)(?<!\w)_(?!\w)", r"\\_")
    out = F.regexp_replace(out, r"(?<!\*)\*(?!\*)", r"\\*")
    return F.regexp_replace(out, r"\[([^\]]*)\](?!\()", r"\\[$1\\]")


def space_emoji(text: Column) -> Column:
    """A space between an emoji and a letter."""
    return F.regexp_replace(text, "([\U0001f600-\U0001f64f\U0001f480-\U0001f6d4])([А-Яа-яA-Za-z])", "$1 $2")


#: Fixed value: the signs that begin a section.
SECTION_SIGNS = "📋🏠💼🔗⚠️💡📝📞"


def space_sections(text: Column) -> Column:
    """At most one blank line, and one before each section sign."""
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, f"([^\n])([{SECTION_SIGNS}])", "$1\n\n$2")


def has_source_section(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iu)🔗.*(?:джерел|посилан)"), F.lit(False))


def source_section(sources: Column, heading: str = "\n\n🔗 Джерела:\n") -> Column:
    """A list of the sources with distinct URLs: title, else source, before the URL; '' if none has one."""
    urls = F.transform(sources, lambda s: F.coalesce(s["url"], F.lit("")))
    kept = F.filter(
        F.transform(sources, lambda s, k: F.when((F.coalesce(s["url"], F.lit("")) != "") & (F.array_position(urls, s["url"]) == k + 1), s)),
        lambda s: s.isNotNull(),
    )

    def line(s: Column) -> Column:
        title, source = F.coalesce(s["title"], F.lit("")), F.coalesce(s["source"], F.lit(""))
        name = F.when(title != "", F.concat(title, F.lit(": "))).when(source != "", F.concat(source, F.lit(": "))).otherwise("")
        return F.concat(F.lit("• "), name, s["url"], F.lit("\n"))

    lines = F.array_join(F.transform(kept, line), "")
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(F.lit(heading), lines)).otherwise("")


def format_message(text: Column, sources: Column | None = None) -> Column:
    """Escaping, spacing, the source section unless there is one, and the cut to size."""
    out = space_sections(space_emoji(escape_marks(text)))
    if sources is not None:
        out = F.when(has_source_section(out), out).otherwise(F.concat(out, source_section(sources)))
    return truncate(out)


def guarded(text: Column, required: list[str], notice: str, prohibited: list[str], fallback: str) -> Column:
    """The fallback for a text with a prohibited phrase, else the text, with the notice if no required phrase stands in it."""
    with_notice = F.when(mentions_any(text, required), text).otherwise(F.concat(text, F.lit(notice)))
    return F.when(mentions_any(text, prohibited), fallback).otherwise(with_notice)


def lookup(key: Column, values: dict[str, str], otherwise: str) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(otherwise))


def tool_page(title: Column, url: Column, content: Column, links: Column, most_links: int = 10) -> Column:
    """A page as marked-up text, with its first links."""
    listed = F.array_join(F.transform(F.slice(links, 1, most_links), lambda x: F.concat(F.lit("- ["), x["text"], F.lit("]("), x["href"], F.lit(")"))), "\n")
    tail = F.when(F.coalesce(F.size(links), F.lit(0)) > 0, F.concat(F.lit("\n\n## Links\n"), listed)).otherwise("")
    return F.concat(F.lit("# "), title, F.lit("\n\n**Source:** "), url, F.lit("\n\n## Content\n"), content, tail)


def scraped_page(
    title: Column, url: Column, scraped_at: Column, cached: Column, published: Column, content: Column, links: Column, content_length: Column, num_links: Column,
    official: Column, most_links: int = 10,
) -> Column:
    """A fetched page as marked-up text: where and when it was read, its content, first links and counts."""
    item = lambda x: F.concat(F.lit("- ["), x["text"], F.lit("]("), x["href"], F.lit(")"))
    has_links = F.coalesce(F.size(links), F.lit(0)) > 0
    parts = F.array(
        F.concat(F.lit("# "), title),
        F.concat(F.lit("**Source:** "), url),
        F.concat(F.lit("**Scraped:** "), F.date_format(scraped_at, "yyyy-MM-dd HH:mm"), F.lit(" UTC")),
        F.when(cached, F.lit("**Status:** Cached content")),
        F.when(F.coalesce(published, F.lit("")) != "", F.concat(F.lit("**Published:** "), published)),
        F.lit(""),
        F.concat(F.lit("## Content\n"), F.coalesce(content, F.lit("")), F.lit("\n")),
        F.when(has_links, F.concat(F.lit("## Relevant Links\n"), F.array_join(F.transform(F.slice(links, 1, most_links), item), "\n"), F.lit("\n"))),
        F.lit("## Metadata"),
        F.concat(F.lit("- Content length: "), F.coalesce(content_length, F.lit(0)).cast("string"), F.lit(" characters")),
        F.concat(F.lit("- Number of links: "), F.coalesce(num_links, F.lit(0)).cast("string")),
        F.when(official, F.lit("- **Official UK Government Source**")),
    )
    return F.array_join(parts, "\n")


def parse_tool_page(page: Column) -> Column:
    """struct(title, url, content) read back: the last heading names it, content runs to the next section, blank lines dropped."""
    lines = F.split(page, "\n", -1)
    titles = F.filter(lines, lambda x: x.startswith("# "))
    urls = F.filter(lines, lambda x: F.contains(x, F.lit("**Source:**")))
    body = F.regexp_extract(page, r"(?s)(?:^|\n)## Content\n(.*?)(?:\n## .*)?$", 1)
    content = F.array_join(F.filter(F.split(body, "\n", -1), lambda x: strip(x) != ""), "\n")
    return F.struct(
        F.coalesce(strip(F.substring(F.try_element_at(titles, F.lit(-1)), 3, 1_000_000)), F.lit("")).alias("title"),
        F.coalesce(strip(F.regexp_replace(F.try_element_at(urls, F.lit(1)), r"^.*\*\*Source:\*\*", "")), F.lit("")).alias("url"),
        content.alias("content"),
    )


def prompt(query: Column, context: Column, with_context: str, without_context: str) -> Column:
    """One of two templates with {query} and {context} filled in."""
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{context}"), F.coalesce(context, F.lit(""))), F.lit("{query}"), query)
    return F.when(F.coalesce(context, F.lit("")) != "", fill(with_context)).otherwise(fill(without_context))


def joined_contexts(base: Column, web_url: Column, web_title: Column, web_content: Column, base_heading: str, web_heading: str) -> Column:
    """Two contexts under their headings; a missing one falls away."""
    first = F.when(F.coalesce(base, F.lit("")) != "", F.concat(F.lit(base_heading + "\n"), base, F.lit("\n\n"))).otherwise("")
    second = F.when(
        F.coalesce(web_content, F.lit("")) != "",
        F.concat(F.lit(web_heading + "\n"), F.lit("Джерело: "), web_url, F.lit("\nЗаголовок: "), web_title, F.lit("\n\n"), web_content, F.lit("\n")),
    ).otherwise("")
    return F.when(web_content.isNull(), base).otherwise(F.concat(first, second))


# When to look beyond the index.

#: Words that ask for something recent, names of schemes, and words of health questions.
FRESH_WORDS = ["recent", "latest", "new", "current", "today", "now", "останні", "нові", "актуальні", "поточні", "свіжі"]
SCHEME_WORDS = ["homes for ukraine", "ukraine scheme", "схема", "програма"]
HEALTH_WORDS = ["nhs", "doctor", "gp", "hospital", "health", "medical", "лікар", "лікарня", "здоров'я", "медичн"]
FEW_DOCUMENTS, LEAST_PAGE = 2, 200


def needs_search(query: Column, found_documents: Column) -> Column:
    """Whether a question should be looked up outside: too little was found, or it asks for news or a scheme."""
    return (found_documents < FEW_DOCUMENTS) | mentions_any(query, [*FRESH_WORDS, *SCHEME_WORDS])


def search_subject(query: Column) -> Column:
    return F.when(mentions_any(query, HEALTH_WORDS), "health").otherwise("housing")


def fuller_page(first: Column, second: Column, subject: Column) -> Column:
    """The first page (struct with content), unless it is missing or short; then the second if there is one, for housing only if it is longer."""
    size = lambda page: F.coalesce(F.length(page["content"]), F.lit(0))
    instead = second.isNotNull() & ((subject == "health") | (size(second) > size(first)))
    return F.when((size(first) < LEAST_PAGE) & instead, second).otherwise(first)
