"""Problem 2: page boilerplate mixed with main content.

Union-free regular-expression inference. Pages of one host are streams of line tokens (a
line with its digits, host names, bullets and spacing generalised). A host's wrapper is a
sequence of optional places, each for one token; between them are text slots. Each page is
aligned with the wrapper (a longest common subsequence): a line that aligns adds to its
place, a mismatch makes a new optional place behind the last aligned one, so a token met in
several orders has several places. Places and tokens that stay below the share a template
needs fall back into text slots, by lossy counting: none above the share is ever lost, and
a wrapper stays small whatever the number of pages. Template tokens are those that stand on
``SUPPORT`` of the host's pages, counted exactly once the candidates are known.

Wrappers are merged by the same alignment, so the inference is a tree: pages are spread
over (host, salt) groups of bounded size, each group gives a partial wrapper, and partial
wrappers are merged ``FAN`` at a time. Copies of a page are dropped before. Texts are read
once; what is kept and shuffled are the hashes of their lines. All pages are used; a host
with a third of them is many groups.

To extract, each page is aligned with its host's wrapper. A line is furniture if it is aligned,
that is, stands where the wrapper has a place for it; the same line elsewhere is text. Three
kinds of slots are resolved by what is aligned around them, over all hosts:

* repeated groups of title slots: a place is the head of one if two or more lines of the
  shape of titles, alike in their bullets, stand right behind it on ``HEADS`` of its pages;
* labelled slots ("label: text", "first › second"): the label is template if more lines that
  begin with it than not stand next to furniture;
* optional lines too rare on every host for a place: the same test for the line itself.

"More than not" is meant with statistical certainty (the lower Wilson bound). A page's first
text line, where its title stands, says nothing about such slots (but for paths) and is left
out of the tests.

Null and empty pages have no lines. Pages without a host form one host of their own. Extra
columns are ignored. A host with fewer than ``LEAST_PAGES`` different pages has no template.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.residue import is_residue
from loomline.session import checkpointed, scattered, spread

#: Share of a host's pages a template line stands on, at least, and pages.
SUPPORT, LEAST_PAGES = 0.08, 3
#: Lossy counting: counts are short by this share of the pages at most; a place has more than it.
ERROR = 0.02
#: A place heads a group of titles if two or more stand behind it on this share of its pages.
HEADS = 0.75
#: Occurrences a labelled or rare optional slot has at least, the share of them next to furniture, and the certainty of it.
LEAST_SEEN, BESIDE, CERTAINTY = 5, 0.5, 1.96
#: Letters of a label.
LABEL_LETTERS = 40
#: Pages of an inference group; partial wrappers merged at a time.
GROUP, FAN = 512, 32
#: Longer lines are hashed like any other, but not kept in memory by their form.
LONG = 300
#: Rows and places of what is sent to every executor; beyond, it is joined with the pages' hashes.
MOST_ROWS, MOST_PLACES = 200_000, 2_000_000

_HOSTS = re.compile(r"(?:https?://)?(?:www\.)?[\w\-]+(?:\.[\w\-]+)*\.[a-z]{2,}(?:/\S*)?")
#: The same for long lines, in one pass over what has no spaces.
_HOSTS_LONG = re.compile(r"(?<![\w\-.])" + _HOSTS.pattern)
_LEAD = re.compile(r"[^\w#©]+")
_DOTTED = re.compile(r"\.[a-z]{2}")
_INVISIBLE = re.compile("[­​-‍⁠﻿]+")
_DIGITS = re.compile(r"\d+")
_CRUMB = re.compile(r"\s[›»>→/]\s")
_LABEL = re.compile(rf"([^\W\d_][^:.!?#]{{0,{LABEL_LETTERS - 1}}}?)\s*:\s+\S")
_BULLET = re.compile(r"\s*([›»→•*·\-–—>▪‣]*)\s*")
_ENDS_SENTENCE = re.compile(r"[.;!?…:,]\s*$")


def token(line: str, host: str | None) -> str:
    """The generalised form of a line, '' for a blank one."""
    low = line.lower()
    if host and host in low:
        low = low.replace(host, " ~ ")
    if _DOTTED.search(low):
        low = (_HOSTS if len(low) <= LONG else _HOSTS_LONG).sub(" ~ ", low)
    low = _DIGITS.sub("#", low)
    m = _LEAD.match(low)
    if m:
        low = low[m.end() :]
    if not low.isascii():
        low = _INVISIBLE.sub(" ", low)
    return " ".join(low.split()).strip(" .:")


def label(form: str) -> str | None:
    """What a line of labelled text begins with, up to its first separator."""
    m = _CRUMB.search(form)
    if m and m.start():
        return form[: m.start()] + " ›"
    m = _LABEL.match(form) if ":" in form else None
    return m[1] + ":" if m else None


def token_hash(form: str) -> int:
    return int.from_bytes(blake2b(form.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


_forms: dict[str, tuple[int, int]] = {}


def _hashes(form: str) -> tuple[int, int]:
    """The hashes of a form and of its label (0 if it has none); short forms recur and are kept in a bounded memory."""
    found = _forms.get(form)
    if found is None:
        name = label(form)
        # an odd number marks a path like "first › second", which is no title
        found = (token_hash(form), 0 if not name else token_hash(name) | 1 if name.endswith("›") else token_hash(name) & ~1)
        if len(form) <= LONG:
            if len(_forms) > 300_000:
                _forms.clear()
            _forms[form] = found
    return found


def stream(text: str, host: str | None) -> list[tuple[int, int, int, int]]:
    """(line_no, token, label, style) of the non-empty lines: hashes, and 0 or a number of the bullets of a line shaped like a title."""
    host = host.lower() if host else None
    out = []
    for k, line in enumerate(text.split("\n")):
        if line and not line.isspace():
            form = token(line, host)
            if form:
                style = 0 if _ENDS_SENTENCE.search(line) else 1 + crc32(_BULLET.match(line)[1].encode()) % 1_000_003
                out.append((k, *_hashes(form), style))
    return out


def align(tokens: list[int], at: dict[int, list[int]]) -> list[tuple[int, int]]:
    """(position, place) of a longest common subsequence of a page and a wrapper, given the places of each token in order."""
    tails: list[int] = []
    chains: list[tuple] = []
    for position, t in enumerate(tokens):
        for place in reversed(at.get(t, ())):  # the last first, so that a line takes one place
            j = bisect_left(tails, place)
            chain = (position, place, chains[j - 1] if j else None)
            if j == len(tails):
                tails.append(place)
                chains.append(chain)
            else:
                tails[j], chains[j] = place, chain
    out, chain = [], chains[-1] if chains else None
    while chain:
        out.append((chain[0], chain[1]))
        chain = chain[2]
    return out[::-1]


def places_of(order: list[int]) -> dict[int, list[int]]:
    at: dict[int, list[int]] = {}
    for k, t in enumerate(order):
        at.setdefault(t, []).append(k)
    return at


class Wrapper:
    """Optional places in order, [token, pages, slack], and the pages of each token, [pages, slack]."""

    def __init__(self):
        self.pages = 0
        self.tokens: dict[int, list[int]] = {}
        self.places: list[list[int]] = []
        self._due = math.ceil(1 / ERROR)

    def align_page(self, tokens: list[int]) -> None:
        """Align one page and resolve the mismatches."""
        self._align(tokens, [(1, 0)] * len(tokens), dict.fromkeys(tokens, (1, 0)), 1, 0)

    def merge(self, other: Wrapper) -> None:
        """Align another wrapper, place by place; what it dropped earlier may have been short by its slack."""
        gain = {t: tuple(n) for t, n in other.tokens.items()}
        self._align([p[0] for p in other.places], [(p[1], p[2]) for p in other.places], gain, other.pages, math.floor(ERROR * other.pages))

    def _align(self, order: list[int], weights: list[tuple[int, int]], gain: dict[int, tuple[int, int]], pages: int, missing: int) -> None:
        slack = math.floor(ERROR * self.pages)
        met = dict(align(order, places_of([p[0] for p in self.places])))
        if missing:
            for t, node in self.tokens.items():
                if t not in gain:
                    node[1] += missing
        for t, (n, short) in gain.items():
            node = self.tokens.setdefault(t, [0, slack])
            node[0] += n
            node[1] += short
        fresh: dict[int, list[list[int]]] = {}
        last, aligned = -1, set(met.values())
        if missing:
            for k, p in enumerate(self.places):
                if k not in aligned:
                    p[2] += missing
        for position, t in enumerate(order):
            n, short = weights[position]
            place = met.get(position)
            if place is None:  # an optional place behind the last aligned one
                fresh.setdefault(last, []).append([t, n, short + slack])
            else:
                self.places[place][1] += n
                self.places[place][2] += short
                last = place
        if fresh:
            merged = fresh.get(-1, [])
            for k, p in enumerate(self.places):
                merged.append(p)
                merged += fresh.get(k, ())
            self.places = merged
        self.pages += pages
        if self.pages >= self._due:
            self._prune()

    def _prune(self) -> None:
        """Tokens and places that cannot reach the share become text slots."""
        least = ERROR * self.pages
        self.tokens = {t: n for t, n in self.tokens.items() if n[0] + n[1] > least}
        self.places = [p for p in self.places if p[0] in self.tokens and p[1] + p[2] > least]
        self._due = self.pages + math.ceil(1 / ERROR)

    def candidates(self) -> list[int]:
        """The tokens that may have the support: their count may be short by their slack."""
        return [t for t, n in self.tokens.items() if n[0] + n[1] >= max(SUPPORT * self.pages, LEAST_PAGES)]

    def template(self, tokens: set[int]) -> list[int]:
        """The tokens of the places in order, of those given."""
        return [p[0] for p in self.places if p[0] in tokens and p[1] + p[2] >= max(LEAST_PAGES, ERROR * self.pages)]


_PART = "host string, salt int, pages int, tokens array<bigint>, token_counts array<int>, places array<bigint>, place_counts array<int>"


def _dump(host: str, salt: int, w: Wrapper) -> pd.DataFrame:
    counts = lambda rows: [x for row in rows for x in row]
    return pd.DataFrame({
        "host": [str(host)], "salt": [int(salt)], "pages": [w.pages], "tokens": [list(w.tokens)], "token_counts": [counts(w.tokens.values())],
        "places": [[p[0] for p in w.places]], "place_counts": [counts(p[1:] for p in w.places)],
    })


def _load(row) -> Wrapper:
    out = Wrapper()
    out.pages = int(row.pages)
    pairs = lambda flat: [[int(flat[k]), int(flat[k + 1])] for k in range(0, len(flat), 2)]
    out.tokens = dict(zip(map(int, row.tokens), pairs(row.token_counts)))
    out.places = [[int(t), *n] for t, n in zip(row.places, pairs(row.place_counts))]
    out._due = out.pages + math.ceil(1 / ERROR)
    return out


def pages_of(table: DataFrame, rec_table: str, id_col: str, text: str, host) -> DataFrame:
    """(rec_table, rec_id, host, text) of a table of pages."""
    return table.select(
        F.lit(rec_table).alias("rec_table"), F.col(id_col).cast("long").alias("rec_id"), F.coalesce(host, F.lit("")).alias("host"), F.col(text).alias("text")
    )


_STREAM = "rec_table string, rec_id bigint, host string, kept boolean, page bigint, line_no array<int>, token array<bigint>, label array<bigint>, style array<int>"
_STREAM_TYPES = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
_STREAM_NAMES = [c.split()[0] for c in _STREAM.split(", ")]


def _lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of a column of numbers, by one conversion of all its values."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def streams(pages: DataFrame, skip_residue_of: tuple[str, ...] = ()) -> DataFrame:
    """One row of line hashes a page with lines; ``kept`` is false for cases of problem 10 in the tables named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            ends, flat = [0], [[] for _ in range(4)]
            for rec_table, rec_id, host, text in zip(*(batch.column(c).to_pylist() for c in ("rec_table", "rec_id", "host", "text"))):
                lines = stream(text, host) if text else None
                if not lines:
                    continue
                columns = tuple(zip(*lines))
                tokens = columns[1]
                for values, own in zip(flat, columns):
                    values += own
                ends.append(len(flat[0]))
                whole = int.from_bytes(blake2b(repr(tokens).encode(), digest_size=8).digest(), "big", signed=True)
                kept = not (rec_table in skip_residue_of and is_residue(text))
                for column, value in zip(out, (rec_table, rec_id, host, kept, whole)):
                    column.append(value)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t.value_type), type=t) for v, t in zip(flat, _STREAM_TYPES[5:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, _STREAM_TYPES)), *lists], _STREAM_NAMES)

    return spread(pages.select("rec_table", "rec_id", "host", "text")).mapInArrow(run, _STREAM)


def infer_wrappers(read: DataFrame) -> DataFrame:
    """(host, pages, places): the template of each host in order, from all its different pages."""
    distinct = checkpointed(read.groupBy("host", "page").agg(F.first("token").alias("token")))
    sizes = distinct.groupBy("host").count().where(F.col("count") > GROUP)
    # one number to the driver: how often partial wrappers have to be merged
    largest = sizes.agg(F.max("count")).collect()[0][0] or 0
    salted = distinct.withColumn("salt", F.lit(0))
    if largest:
        hot = sizes.select("host", F.ceil(F.col("count") / GROUP).cast("int").alias("salts"))
        salted = distinct.join(hot, "host", "left").withColumn("salt", F.coalesce(F.pmod("page", "salts"), F.lit(0)).cast("int")).drop("salts")

    def infer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper = Wrapper()
        for tokens in pdf.sort_values("page")["token"]:
            wrapper.align_page(tokens.tolist())
        return _dump(key[0], key[1], wrapper)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for row in pdf.sort_values("salt").itertuples():
            if wrapper is None:
                wrapper = _load(row)
            else:
                wrapper.merge(_load(row))
        return _dump(key[0], key[1], wrapper)

    wrappers = scattered(salted, "host", "salt").groupBy("host", "salt").applyInPandas(infer, _PART)
    groups = math.ceil(largest / GROUP)
    while groups > 1:
        wrappers = wrappers.groupBy("host", F.floor(F.col("salt") / FAN).cast("int").alias("salt")).applyInPandas(merge, _PART)
        groups = math.ceil(groups / FAN)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(row.host, row.pages, c, w.template(set(c))) for row in pdf.itertuples() if (c := (w := _load(row)).candidates())]
            yield pd.DataFrame(found, columns=["host", "pages", "tokens", "places"])

    found = checkpointed(wrappers.mapInPandas(candidates, "host string, pages int, tokens array<bigint>, places array<bigint>"))
    # lossy counts are only bounds: the candidates' pages are counted
    pages = distinct.join(_small(found.select("host", "tokens"), "tokens"), "host").select("host", F.explode(F.array_intersect("token", "tokens")).alias("t"))
    counted = pages.groupBy("host", "t").count().join(_small(found.select("host", "pages"), None), "host")
    enough = counted.where((F.col("count") >= LEAST_PAGES) & (F.col("count") >= SUPPORT * F.col("pages"))).groupBy("host").agg(F.collect_list("t").alias("enough"))
    kept = found.join(enough, "host").select("host", "pages", F.filter("places", lambda t: F.array_contains("enough", t)).alias("places"))
    return kept.where(F.size("places") > 0)


def _small(df: DataFrame, places: str | None) -> DataFrame:
    """The table marked for broadcast if its rows, and the places in them, are few enough."""
    n, m = df.agg(F.count(F.lit(1)), F.sum(F.size(places)) if places else F.lit(0)).collect()[0]
    return F.broadcast(df) if n <= MOST_ROWS and (m or 0) <= MOST_PLACES else df


HEAD, LABEL, LINE = 0, 1, 2


def furniture(tokens: list[int], labels: list[int], styles: list[int], at: dict[int, list[int]], slots: dict[int, int] | None = None) -> tuple[set[int], set[int]]:
    """(aligned, furniture): positions of a page's lines, by its host's places and the slots resolved so far (a bit mask by hash)."""
    aligned = {position for position, _ in align(tokens, at)} if at else set()
    found = set(aligned)
    if slots:
        for k, (t, name) in enumerate(zip(tokens, labels)):
            if k not in found and (slots.get(t, 0) >> LINE & 1 or name and slots.get(name, 0) >> LABEL & 1):
                found.add(k)
        for k in sorted(found):
            if slots.get(tokens[k], 0) >> HEAD & 1:
                found.update(range(k + 1, k + 1 + titles_behind(styles, found, k)))
    return aligned, found


def titles_behind(styles: list[int], known: set[int], k: int) -> int:
    """How many lines shaped like titles, alike in their bullets, stand right behind a line."""
    j = k + 1
    while j < len(styles) and j not in known and styles[j] and styles[j] == styles[k + 1]:
        j += 1
    return j - k - 1


def _with_places(read: DataFrame, templates: DataFrame) -> DataFrame:
    return read.join(_small(templates.select("host", "places"), "places"), "host", "left")


class _Slots:
    """Resolved slots, (hash, kinds): sent to the executors if they are few, else joined with the pages they stand on."""

    def __init__(self, found: DataFrame | None):
        self.found, self.shared = found, None
        if found is not None and found.count() <= MOST_PLACES:
            self.shared = found.sparkSession.sparkContext.broadcast({r.hash: r.kinds for r in found.toLocalIterator()})

    def added(self, read: DataFrame) -> DataFrame:
        if self.found is None or self.shared is not None:
            return read.withColumn("own", F.lit(None).cast("map<bigint,int>"))
        stand = read.select("rec_table", "rec_id", F.explode(F.array_distinct(F.concat("token", "label"))).alias("hash")).distinct()
        own = stand.join(self.found, "hash").groupBy("rec_table", "rec_id").agg(F.map_from_entries(F.collect_list(F.struct("hash", "kinds"))).alias("own"))
        return read.join(own, ["rec_table", "rec_id"], "left")


def _over_pages(read: DataFrame, slots: _Slots, each, schema: str) -> DataFrame:
    """``each(rows, result)`` over the batches; a row is (rec_table, rec_id, kept, line_no, tokens, labels, aligned, furniture, styles)."""
    shared, names = slots.shared, [c.split()[0] for c in schema.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, list[int]]] = {}
        for batch in batches:
            rows, places = [], batch.column("places")
            plain = (batch.column(c).to_pylist() for c in ("rec_table", "rec_id", "host", "kept", "own"))
            lists = (_lists(batch.column(c)) for c in ("line_no", "token", "label", "style"))
            for k, (rec_table, rec_id, host, kept, own, numbers, tokens, labels, styles) in enumerate(zip(*plain, *lists)):
                at = known.get(host)
                if at is None:
                    if len(known) > 10_000:
                        known.clear()
                    at = known[host] = places_of(places[k].as_py() or [])
                aligned, found = furniture(tokens, labels, styles, at, shared.value if shared else dict(own) if own else None)
                rows.append((rec_table, rec_id, kept, numbers, tokens, labels, aligned, found, styles))
            out: list[list] = [[] for _ in names]
            each(rows, out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return slots.added(read).mapInArrow(run, schema)


def _wilson(k, n):
    """The lower bound of a share of k in n."""
    z = CERTAINTY
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _resolve(read: DataFrame, slots: _Slots, kinds: tuple[int, ...]) -> DataFrame:
    """(hash, kinds) of the slots of some kinds, from counts over all pages."""

    def count(rows: list[tuple], out: list[list]) -> None:
        seen: tuple[dict[int, list[int]], ...] = ({}, {}, {})

        def add(kind: int, name: int, yes: bool) -> None:
            n = seen[kind].get(name)
            if n is None:
                seen[kind][name] = [1, int(yes)]
            else:
                n[0] += 1
                n[1] += yes

        for _, _, _, _, tokens, labels, aligned, found, styles in rows:
            first = next((k for k in range(len(tokens)) if k not in found), None)  # where the page's title stands
            for k, t in enumerate(tokens):
                if k in aligned:
                    if HEAD in kinds and k + 1 != first:
                        add(HEAD, t, titles_behind(styles, found, k) >= 2)
                elif k not in found:
                    beside = k - 1 in found or k + 1 in found
                    if LINE in kinds and k != first:
                        add(LINE, t, beside)
                    if LABEL in kinds and labels[k] and (k != first or labels[k] & 1):
                        add(LABEL, labels[k], beside)
        for kind, counts in enumerate(seen):
            out[0] += [kind] * len(counts)
            out[1] += counts
            out[2] += [n for n, _ in counts.values()]
            out[3] += [yes for _, yes in counts.values()]

    counts = _over_pages(read, slots, count, "kind int, hash bigint, n bigint, yes bigint").groupBy("kind", "hash").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes"))
    n, yes = F.col("n").cast("double"), F.col("yes").cast("double")
    good = F.when(F.col("kind") == HEAD, (n >= LEAST_PAGES) & (yes >= HEADS * n)).otherwise((n >= LEAST_SEEN) & (_wilson(yes, n) >= BESIDE))
    return counts.where(good).groupBy("hash").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("kind"))).cast("int").alias("kinds"))


def page_furniture(pages: DataFrame, skip_residue_of: tuple[str, ...] = ("documents",)) -> DataFrame:
    """(rec_table, rec_id, line_no) of the lines that are not the page's own content.

    Tables in ``skip_residue_of`` come out without the cases of problem 10.
    """
    read = checkpointed(streams(pages, skip_residue_of))
    placed = _with_places(read, checkpointed(infer_wrappers(read)))
    groups = checkpointed(_resolve(placed, _Slots(None), (HEAD, LABEL)))
    lines = _resolve(placed, _Slots(groups), (LINE,))
    slots = _Slots(checkpointed(groups.unionByName(lines).groupBy("hash").agg(F.bit_or("kinds").alias("kinds"))))

    def extract(rows: list[tuple], out: list[list]) -> None:
        for rec_table, rec_id, kept, numbers, _, _, _, found, _ in rows:
            if kept:
                for k in sorted(found):
                    for column, value in zip(out, (rec_table, rec_id, numbers[k])):
                        column.append(value)

    return _over_pages(placed, slots, extract, "rec_table string, rec_id bigint, line_no bigint")


def main_content(pages: DataFrame, **options) -> DataFrame:
    """(rec_table, rec_id, text, n_removed): each page with its own lines only, those with cases of problem 10 too."""
    found = page_furniture(pages, **{"skip_residue_of": ()} | options)
    drop = found.groupBy("rec_table", "rec_id").agg(F.collect_set("line_no").alias("drop"))
    joined = pages.join(drop, ["rec_table", "rec_id"], "left")
    lines = F.transform(F.split("text", "\n", -1), lambda x, k: F.struct(k.cast("long").alias("k"), x.alias("line")))
    kept = F.filter(lines, lambda x: ~F.array_contains("drop", x["k"]))
    clean = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return joined.select("rec_table", "rec_id", clean.alias("text"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias("n_removed"))
