"""HTML pages parsed with the standard library, in Arrow batches.

One pass builds a light tree; profiles say which container holds the main content, which
subtrees are dropped, and which paragraphs and list items count. Malformed markup is
recovered as html.parser does it. A page that is null or blank has a null result.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements an opening tag closes implicitly.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        """The element and those below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find_all(self, *tags: str):
        return (n for n in self.walk() if n.tag in tags)

    def find(self, *tags: str) -> Node | None:
        return next(self.find_all(*tags), None)

    def text(self) -> str:
        """Every text node stripped, put together without a separator."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node.strip())
            else:
                stack += reversed(node.children)
        return "".join(out)

    def raw_text(self) -> str:
        """Every text node as it is, put together."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def drop(self, test) -> None:
        """Takes subtrees out."""
        for node in self.walk():
            node.children = [c for c in node.children if not (isinstance(c, Node) and test(c))]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closing = _CLOSES.get(tag, {"p"} if tag in _BLOCKS else set())
        if closing and self.open[-1].tag in closing:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


@dataclass(frozen=True)
class Profile:
    """How a kind of page is read. Containers are tried in order; '.name' is a class, '#name' an id, else a tag.

    ``whole_text`` takes all text of the container, line by line, instead of its paragraphs. ``letters`` makes
    paragraphs of more than ``least_lettered`` characters with one of them the content if only the body is left.
    """

    containers: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ("script", "style", "nav", "footer", "header")
    least_paragraph: int = 1
    least_item: int | None = None
    phrases: tuple[str, ...] = ()
    title_suffix: str = ""
    untitled: str = "Untitled"
    least_content: int = 0
    whole_text: bool = False
    letters: str = ""
    least_lettered: int = 50


GENERIC = Profile()
#: The main column of official pages, phrases of theirs that are no content, the suffix of their titles.
OFFICIAL = Profile(
    containers=(".govuk-grid-column-two-thirds", "article", "main", "body"), least_paragraph=20, least_item=11,
    phrases=("print this page", "is this page useful", "report a problem", "cookies on gov.uk"), title_suffix=" - GOV.UK",
)
#: The content containers of community pages.
_COMMUNITY_CONTAINERS = (".content", ".main-content", ".article-content", ".post-content", "#content", "#main-content", "article", "main", "body")
_ASIDES = ("script", "style", "nav", "footer", "header", "aside", "iframe")
COMMUNITY = Profile(containers=_COMMUNITY_CONTAINERS, dropped=_ASIDES, least_paragraph=21)
#: The same pages read whole; pages of less than 100 characters are left out.
COMMUNITY_WHOLE = Profile(containers=_COMMUNITY_CONTAINERS, dropped=_ASIDES, whole_text=True, letters="іїєґІЇЄҐ", least_content=100)
OFFICIAL_WHOLE = Profile(containers=OFFICIAL.containers, dropped=_ASIDES, whole_text=True, title_suffix=OFFICIAL.title_suffix, least_content=100)


def _container(root: Node, profile: Profile) -> Node:
    for name in profile.containers:
        if name.startswith("."):
            test = lambda n, c=name[1:]: n.has_class(c)
        elif name.startswith("#"):
            test = lambda n, i=name[1:]: n.attrs.get("id") == i
        else:
            test = lambda n, t=name: n.tag == t
        found = next((n for n in root.walk() if test(n)), None)
        if found is not None:
            return found
    return root


def read_page(html: str | None, url: str | None = None, profile: Profile = GENERIC) -> dict | None:
    """title, content, links and counts of a page."""
    if not isinstance(html, str) or not html.strip():
        return None
    root = parse(html)
    meta = {m.attrs.get("name", m.attrs.get("property", "")).lower(): m.attrs.get("content", "") for m in root.find_all("meta")}
    language = next((n.attrs["lang"] for n in root.find_all("html") if n.attrs.get("lang")), None)
    head_title = root.find("title")
    moments = [n.attrs.get("datetime") for n in root.find_all("time") if n.attrs.get("datetime")]
    root.drop(lambda n: n.tag in profile.dropped)
    heading = root.find("h1")
    title = heading.text() if heading is not None else ""
    if not title and head_title is not None:
        title = head_title.text().removesuffix(profile.title_suffix) if profile.title_suffix else ""
    main = _container(root, profile)
    paragraphs = [p.text() for p in main.find_all("p")]
    kept = [p for p in paragraphs if len(p) >= profile.least_paragraph and not any(x in p.lower() for x in profile.phrases)]
    if profile.least_item is not None:
        for group in main.find_all("ul", "ol"):
            items = [f"• {t}" for c in group.children if isinstance(c, Node) and c.tag == "li" and len(t := c.text()) >= profile.least_item]
            if items:
                kept.append("\n".join(items))
    content = "\n\n".join(kept)
    if profile.whole_text:
        lettered = []
        if profile.letters and main.tag in ("", "body"):
            found = (p.raw_text().strip() for p in root.find_all("p"))
            lettered = [t for t in found if len(t) > profile.least_lettered and any(c in t for c in profile.letters)]
        whole = "\n\n".join(lettered) if lettered else main.raw_text()
        content = "\n".join(line for line in map(str.strip, whole.splitlines()) if line)
    if len(content) < profile.least_content:
        return None
    links = []
    for a in main.find_all("a"):
        text, href = a.text(), a.attrs.get("href", "")
        if text and href:
            links.append({"text": text, "href": urljoin(url, href) if url else href})
    return {
        "title": title or profile.untitled, "content": content, "links": links, "num_paragraphs": len(paragraphs), "num_links": len(links),
        "content_length": len(content), "description": meta.get("description") or meta.get("og:description"), "language": language,
        "publication_date": moments[0] if moments else meta.get("article:published_time"),
    }


_PAGE = (
    "struct<title:string,content:string,links:array<struct<text:string,href:string>>,num_paragraphs:int,num_links:int,content_length:int,"
    "description:string,language:string,publication_date:string>"
)


def page(html: Column, url: Column | None = None, profile: Profile = GENERIC) -> Column:
    @F.pandas_udf(_PAGE)
    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        read = [read_page(h, u if isinstance(u, str) else None, profile) for h, u in zip(pages, urls)]
        empty = dict.fromkeys(("title", "content", "links", "num_paragraphs", "num_links", "content_length", "description", "language", "publication_date"))
        out = pd.DataFrame([r or empty for r in read], columns=list(empty), dtype=object)
        for c in ("num_paragraphs", "num_links", "content_length"):
            out[c] = out[c].astype("Int32")
        return out

    return run(html, url if url is not None else F.lit(None).cast("string"))


def escaped(text: Column) -> Column:
    """Text made safe inside an element."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
