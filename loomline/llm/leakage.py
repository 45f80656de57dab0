"""Problem 9: evaluation texts leaking into training text.

Texts are folded to their letters and digits in lower case, so that case, punctuation,
spacing, line breaks and invisible characters do not matter, and seen as sets of letter
shingles. Test items are short and documents long, so both sides are partitioned by size
before MinHash is used: an item becomes overlapping parts of about the smallest passage to
be found, a document becomes overlapping windows of twice that size (a short document is one
window of its own size). A part contained in a window then has a Jaccard similarity far from
0 whatever the document's length, and ``PERMUTATIONS`` minima find it: a window is a
candidate for an item if they share at least one minimum. Candidates that share fewer shingles
than the worst passage that counts (``least_left``) are dropped, as they can hold none; the
rest is decided by aligning the item's words with the document: first by exact stretches,
then, where these do not suffice, word by word around them.

Items whose letters are few enough (``MOST_LETTERS``, measured) are broadcast, and the
documents are read once in one map stage, without a shuffle. More items stay a table: the
minima of both sides are joined on (permutation, value), with values salted, and the
documents of the candidates are joined again to be aligned. Both ways give the same rows.

Null and empty documents and items have no rows; repeated documents have repeated results,
repeated items one. An item of fewer letters than a shingle is found where all its letters stand in
a row. A passage that counts but has fewer exact letters in a row than a shingle is not told from chance.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import spread

#: Share of an item's words a passage must reproduce, and words of it for one that is changed, missing or added.
SHARE, WORDS_AN_ERROR = 0.4, 8
#: Letters of a shingle; letters of an item part and of a document block (a window is two blocks).
SHINGLE, PART = 12, 160
PERMUTATIONS = 32
#: Letters of the documents looked at in one step.
STEP_LETTERS = 2_000_000
#: Letters of all items that are broadcast; beyond, minima are joined, in so many salts a value.
MOST_LETTERS, SALTS = 5_000_000, 8
#: Letters an exact stretch of the alignment has at least; mean letters of a word, to count added words.
SEED, WORD_LETTERS = 8, 6.0
#: Letters between two words of one run at most; letters of a word that counts away from its neighbours.
REACH, SOLID = 80, 3

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)
_keep_table: np.ndarray | None = None


def _keep() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    global _keep_table
    if _keep_table is None:
        _keep_table = np.array([chr(c).isalnum() for c in range(0x110000)])
    return _keep_table


def fold(text: str) -> str:
    """Letters and digits in lower case."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return codes[_keep()[codes]].tobytes().decode("utf-32-le")


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return codes[_keep()[codes]]


def _doubled(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches of 4 and of SEED (8) letters, by doubling."""
    h = codes.astype(np.uint64) * _M
    h ^= h >> np.uint64(29)
    h2 = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]
    h4 = h2[:-2] * np.uint64(0xA0761D6478BD642F) + h2[2:]
    return h4, h4[:-4] * np.uint64(0xE7037ED1A0B428DB) + h4[4:]


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of SHINGLE letters (12 = 8 + 4)."""
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h4, h8 = _doubled(codes)
        out = h8[:n] * np.uint64(0x8EBC6AF09C88C6E3) + h4[8 : 8 + n]
        return out ^ (out >> np.uint64(31))


def _minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash of the blocks beginning at starts: one row a permutation."""
    out = np.empty((PERMUTATIONS, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for k, m in enumerate(_MULTIPLIERS):
            np.minimum.reduceat(hashes * m, starts, out=out[k])
    return out


def least_left(lengths: list[int], share: float) -> tuple[int, int]:
    """(shingles, letters) that at least stay exact in a passage that counts: the shortest run of each number of words, the longest words changed."""
    n_words = len(lengths)
    ends, longest = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(sorted(lengths, reverse=True))])
    shingles, letters = int(ends[-1]), int(ends[-1])
    for n in range(max(1, math.ceil(share * n_words - 1e-9)), n_words + 1):
        errors = n // WORDS_AN_ERROR
        left = int((ends[n:] - ends[:-n]).min() - longest[errors])
        letters = min(letters, left)
        # an error breaks the shingles that touch its word
        shingles = min(shingles, left - (errors + 1) * (SHINGLE - 1))
    return shingles, letters


class Item:
    """A test item prepared for the alignment."""

    def __init__(self, key, text: str, share: float = SHARE):
        self.key, parts = key, [fold(w) for w in text.split()]
        parts = [p for p in parts if p]
        self.text = "".join(parts)
        ends = np.cumsum([len(p) for p in parts]).tolist()
        self.spans = list(zip([0, *ends[:-1]], ends))
        self.need = max(1, math.ceil(share * len(parts) - 1e-9))
        self._seeds: dict[str, list[int]] | None = None
        every = shingle_hashes(np.frombuffer(self.text.encode("utf-32-le"), np.uint32))
        self.hashes = np.unique(every)
        shingles, self.least_letters = least_left([len(p) for p in parts], share)
        self.least_shingles = shingles - (len(every) - len(self.hashes))  # repeated ones count once

    @property
    def seeds(self) -> dict[str, list[int]]:
        """Where each stretch of SEED letters stands; made for the items that become candidates."""
        if self._seeds is None:
            self._seeds = {}
            for k in range(len(self.text) - SEED + 1):
                self._seeds.setdefault(self.text[k : k + SEED], []).append(k)
            with np.errstate(over="ignore"):
                self._seed_hashes = np.unique(_doubled(np.frombuffer(self.text.encode("utf-32-le"), np.uint32))[1])
        return self._seeds

    def stretches(self, doc: str) -> list[tuple[int, int, int]]:
        """(item start, document start, length) of the maximal exact stretches of at least SEED letters."""
        done: dict[int, int] = {}
        out, text, seeds = [], self.text, self.seeds
        if len(doc) < SEED or not seeds:
            return out
        with np.errstate(over="ignore"):
            own = _doubled(np.frombuffer(doc.encode("utf-32-le"), np.uint32))[1]
        at = np.minimum(np.searchsorted(self._seed_hashes, own), len(self._seed_hashes) - 1)
        for p in np.flatnonzero(self._seed_hashes[at] == own).tolist():
            for a in seeds.get(doc[p : p + SEED], ()):
                if done.get(p - a, -1) > p:
                    continue
                n = SEED
                while a + n < len(text) and p + n < len(doc) and text[a + n] == doc[p + n]:
                    n += 1
                done[p - a] = p + n - SEED + 1
                out.append((a, p, n))
        return out

    def best_run(self, doc: str) -> tuple[int, int]:
        """(item words spanned, errors) of the longest run with at most one error in WORDS_AN_ERROR words."""
        blocks = sorted(self.stretches(doc), key=lambda b: (b[1], b[0]))
        if not blocks:
            return 0, 0
        # the chain of stretches, in order on both sides, with most letters; long gaps cost as much as they skip
        reach = 2 * len(self.text)
        best, back, letters = [float(n) for _, _, n in blocks], [-1] * len(blocks), [n for _, _, n in blocks]
        for j, (a, p, n) in enumerate(blocks):
            for i in range(j - 1, -1, -1):
                b, q, m = blocks[i]
                if p - q > reach:  # no run of few errors spans such a gap
                    break
                cut = max(b + m - a, q + m - p, 0)  # an overlap counts once
                if b < a and q < p and cut < n:
                    gap = abs((a - b - m) - (p - q - m))
                    score = best[i] + n - cut - 0.5 * gap - 0.1 * max(0, p - q - m)
                    if score > best[j]:
                        best[j], back[j], letters[j] = score, i, letters[i] + n - cut
        longest = (0, 0)
        used: set[int] = set()
        for j in sorted(range(len(blocks)), key=lambda j: -best[j]):
            if letters[j] < self.least_letters:
                continue
            chain = []
            while j >= 0 and j not in used:
                chain.append(blocks[j])
                used.add(j)
                j = back[j]
            longest = max(longest, self._run(chain[::-1]), key=lambda r: (r[0], -r[1]))
        return longest if longest[0] >= self.need else max(longest, self._word_run(doc, blocks), key=lambda r: (r[0], -r[1]))

    def _word_run(self, doc: str, blocks: list[tuple[int, int, int]]) -> tuple[int, int]:
        """The longest run found by aligning single words in the parts of the document the stretches lie in."""
        size = len(self.text)
        regions: list[list[int]] = []  # [start, end, exact shingles]
        for a, p, n in sorted(blocks, key=lambda b: b[1] - b[0]):
            start, end = p - a - size // 4 - REACH, p - a + size + size // 4 + REACH
            shingles = max(0, n - SHINGLE + 1)
            if regions and start <= regions[-1][0] + 2 * REACH:
                regions[-1][1] = max(regions[-1][1], end)
                regions[-1][2] += shingles
            else:
                regions.append([start, end, shingles])
        found = (0, 0)
        for start, end, shingles in regions:
            if shingles >= max(1, self.least_shingles):
                found = max(found, self._word_run_in(doc[max(start, 0) : max(end, 0)]), key=lambda r: (r[0], -r[1]))
        return found

    def _word_run_in(self, part: str) -> tuple[int, int]:
        where: dict[str, list[int]] = {}
        matches = []  # (document start, item word, document end)
        for k, (a, b) in enumerate(self.spans):
            word = self.text[a:b]
            at = where.get(word)
            if at is None:
                at, p = where.setdefault(word, []), part.find(word)
                while p >= 0:
                    at.append(p)
                    p = part.find(word, p + 1)
            matches += [(p, k, p + b - a) for p in at]
        # no run has more words than the longest sequence of matches in order on both sides
        tails: list[int] = []
        for _, k in sorted((p, -k) for p, k, _ in matches):
            j = bisect_left(tails, -k)
            if j == len(tails):
                tails.append(-k)
            else:
                tails[j] = -k
        if len(tails) < self.need - self.need // WORDS_AN_ERROR:
            return 0, 0
        starts, ends = {(p, k) for p, k, _ in matches}, {(end, k) for _, k, end in matches}
        # a short word alone may be found by chance: no run begins or ends with it
        matches = sorted((p, k, end, end - p >= SOLID or (end, k + 1) in starts or (p, k - 1) in ends) for p, k, end in matches)
        most = len(self.spans) // WORDS_AN_ERROR
        runs: list[dict[int, int]] = []  # for each match, errors of a run that ends with it: its first item word
        top, low = (0, 0), 0
        for j, (p, k, _, solid) in enumerate(matches):
            while matches[low][0] < p - 2 * REACH:
                low += 1
            own = {0: k} if solid else {}
            for i in range(low, j):
                _, m, end, _ = matches[i]
                skipped, more = k - m - 1, p - end
                if skipped < 0 or skipped > most or more < 0 or more > REACH:
                    continue
                if skipped:
                    gone = self.spans[k][0] - self.spans[m][1]
                    errors = skipped + max(0, round((more - gone) / WORD_LETTERS) - skipped)
                else:
                    errors = max(1, round(more / WORD_LETTERS)) if more else 0
                for e, first in runs[i].items():
                    if e + errors <= most and first < own.get(e + errors, k + 1):
                        own[e + errors] = first
            kept, least = {}, k + 1
            for e in sorted(own):
                if own[e] < least:
                    kept[e] = least = own[e]
                    n = k - least + 1
                    if solid and n > top[0] and e * WORDS_AN_ERROR <= n:
                        top = (n, e)
            runs.append(kept)
        return top

    def _run(self, chain: list[tuple[int, int, int]]) -> tuple[int, int]:
        if not chain:
            return 0, 0
        words, added = len(self.spans), {}
        ok = [False] * words
        starts = [s for s, _ in self.spans]
        merged = []  # stretches with overlaps cut, in item and document
        for a, p, n in chain:
            if merged:
                b, q, m = merged[-1]
                cut = max(b + m - a, q + m - p, 0)
                a, p, n = a + cut, p + cut, n - cut
                if n <= 0:
                    continue
                if a == b + m and p == q + m:
                    merged[-1] = (b, q, m + n)
                    continue
            merged.append((a, p, n))
        for a, _, n in merged:
            k = bisect_left(starts, a)
            while k < words and self.spans[k][1] <= a + n:
                ok[k] = True
                k += 1
        for (b, q, m), (a, p, n) in zip(merged, merged[1:]):
            between, more = a - b - m, p - q - m
            first = bisect_left(starts, b + m + 1) - 1  # the word in which the gap begins
            last = bisect_left(starts, a)
            gone = sum(not ok[k] for k in range(max(first, 0), last))
            extra = (more - between) / WORD_LETTERS
            if not gone and more > 0:
                extra = max(1.0, more / WORD_LETTERS)
            if extra >= 1.0:
                at = min(max(first, 0) + 1, words - 1)
                added[at] = added.get(at, 0) + (round(extra) if not gone else int(max(0, round(extra) - 1)))
        errors = [int(not x) for x in ok]
        for k, n in added.items():
            errors[k] += n
        sums = np.concatenate([[0], np.cumsum(errors)])
        good = [k for k, x in enumerate(ok) if x]
        if not good:
            return 0, 0
        top = (0, 0)
        for i in good:
            for j in reversed(good):
                n = j - i + 1
                if n <= top[0]:
                    break
                e = int(sums[j + 1] - sums[i] - (errors[i] - (not ok[i])))  # words added before the run don't count
                if e * WORDS_AN_ERROR <= n:
                    top = (n, e)
                    break
        return top


def item_minima(item: Item) -> np.ndarray:
    """One row a permutation, one column a part of the item."""
    hashes = shingle_hashes(np.frombuffer(item.text.encode("utf-32-le"), np.uint32))
    parts = [hashes[s : s + PART] for s in range(0, max(1, len(hashes) - PART // 2), PART // 2)]
    starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
    return _minima(np.concatenate(parts), starts)


class Windows:
    """The shingles of some texts, and the minima of their windows."""

    def __init__(self, texts: list[str | None]):
        hashes, starts, owner, offset = [], [], [], 0
        self.spans: dict[int, tuple[int, int]] = {}
        for d, text in enumerate(texts):
            h = shingle_hashes(_codes(text)) if text else ()
            if not len(h):
                continue
            self.spans[d] = (offset, offset + len(h))
            own = np.arange(0, max(1, len(h) - PART // 2), PART)  # the last block takes a short rest
            starts.append(own + offset)
            owner.append(np.full(len(own), d))
            hashes.append(h)
            offset += len(h)
        self.owner = np.concatenate(owner) if owner else np.empty(0, int)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        blocks = _minima(self.hashes, np.concatenate(starts)) if starts else np.empty((PERMUTATIONS, 0), np.uint64)
        last = np.ones(len(self.owner), bool)
        last[:-1] = self.owner[1:] != self.owner[:-1]
        # a window is a block and the next one of the same document
        self.minima = blocks.copy()
        if blocks.shape[1]:
            np.minimum(blocks[:, :-1], blocks[:, 1:], out=self.minima[:, :-1], where=~last[:-1])

    def shingles(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of a text in order, and sorted."""
        own = self.hashes[slice(*self.spans[d])]
        return own, np.sort(own)


def judged(item: Item, shingles: np.ndarray, ranked: np.ndarray, folded) -> tuple[float, int, int] | None:
    """(containment, words in the run, errors) of an item in a document, given its shingles in order and sorted; None if no passage of it counts.

    Only the parts of the document that hold enough of the item's shingles close together are aligned.
    """
    least = max(1, item.least_shingles)
    at = np.minimum(np.searchsorted(ranked, item.hashes), len(ranked) - 1)
    shared = np.count_nonzero(ranked[at] == item.hashes)
    if shared < least:
        return None
    at = np.minimum(np.searchsorted(item.hashes, shingles), len(item.hashes) - 1)
    held = np.flatnonzero(item.hashes[at] == shingles)
    reach = len(item.text) + len(item.text) // 4 + REACH  # no passage spans more
    best = (0, 0)
    for part in np.split(held, np.flatnonzero(np.diff(held) > reach) + 1):
        if len(part) >= least and len(np.unique(at[part])) >= least:
            best = max(best, item.best_run(folded()[max(0, int(part[0]) - reach) : int(part[-1]) + reach]), key=lambda r: (r[0], -r[1]))
    return (shared / len(item.hashes), *best) if best[0] >= item.need else None


class Index:
    """Minima of the parts of some items, and the items."""

    def __init__(self, rows: list[tuple], share: float = SHARE):
        every = [Item(k, t, share) for k, t in rows]
        self.items = [item for item in every if len(item.text) >= SHINGLE]
        self.short = [item for item in every if 0 < len(item.text) < SHINGLE]
        minima: list[list[tuple[int, int]]] = [[] for _ in range(PERMUTATIONS)]
        for number, item in enumerate(self.items):
            for pairs, row in zip(minima, item_minima(item)):
                pairs += [(int(m), number) for m in row]
        self.values, self.numbers = [], []
        for pairs in minima:
            pairs = sorted(set(pairs))
            self.values.append(np.array([v for v, _ in pairs], np.uint64))
            self.numbers.append(np.array([n for _, n in pairs], np.int64))

    def candidates(self, windows: Windows) -> set[tuple[int, int]]:
        """(document number, item number) sharing a minimum."""
        found: set[tuple[int, int]] = set()
        for values, numbers, minima in zip(self.values, self.numbers, windows.minima):
            if not len(values):
                continue
            at = np.searchsorted(values, minima)
            for h in np.flatnonzero(values[np.minimum(at, len(values) - 1)] == minima).tolist():
                v, j = minima[h], at[h]
                while j < len(values) and values[j] == v:
                    found.add((int(windows.owner[h]), int(numbers[j])))
                    j += 1
        return found

    def leaks(self, texts: list[str | None]) -> list[tuple[int, object, float, int, int]]:
        """(document number, item id, containment, words in the run, errors) of the leaks into the texts."""
        windows, out, folded, own, of = Windows(texts), [], {}, None, None

        def text_of(d: int) -> str:
            if d not in folded:
                folded[d] = fold(texts[d])
            return folded[d]

        for d, number in sorted(self.candidates(windows)):
            if of != d:
                of, own = d, windows.shingles(d)
            found = judged(self.items[number], *own, lambda: text_of(d))
            if found:
                out.append((d, self.items[number].key, *found))
        if self.short:
            for d, text in enumerate(texts):
                out += [(d, item.key, 1.0, len(item.spans), 0) for item in self.short if text and item.text in text_of(d)]
        return out


_made: dict[int, Index] = {}


def _index(rows: list[tuple], share: float) -> Index:
    key = hash((tuple(rows), share))
    if key not in _made:
        _made.clear()  # one at a time is in use
        _made[key] = Index(rows, share)
    return _made[key]


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of the texts that bound the arrays of one step, whatever the batch holds."""
    first = 0
    while first < len(texts):
        last, letters = first, 0
        while last < len(texts) and (last == first or letters + len(texts[last] or "") <= STEP_LETTERS):
            letters += len(texts[last] or "")
            last += 1
        yield first, last
        first = last


def _by_broadcast(docs: DataFrame, items: DataFrame, share: float, schema: str) -> DataFrame:
    rows = sorted(((r.k, r.t) for r in items.toLocalIterator()), key=lambda r: (r[0], r[1]))
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(shared.value, share)
        for pdf in batches:
            ids, texts = pdf["i"].tolist(), pdf["t"].tolist()
            out = [(ids[a + d], *rest) for a, b in _steps(texts) for d, *rest in index.leaks(texts[a:b])]
            yield pd.DataFrame(out, columns=["i", "item", "containment", "run_words", "errors"])

    return docs.mapInPandas(run, schema)


def _by_join(docs: DataFrame, items: DataFrame, share: float, schema: str) -> DataFrame:
    """The minima of both sides joined; a value that many windows have is spread over salts."""
    kind, item_kind = docs.schema["i"].dataType.simpleString(), items.schema["k"].dataType.simpleString()

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(int(v), k) for k, t in zip(pdf["k"], pdf["t"]) for v in np.unique(item_minima(Item(k, t, share)).view(np.int64))]
            yield pd.DataFrame(rows, columns=["value", "k"])

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["i"].tolist(), pdf["t"].tolist()
            for a, b in _steps(texts):
                windows = Windows(texts[a:b])
                out = [(ids[a + d], int(v)) for d in windows.spans for v in np.unique(windows.minima[:, windows.owner == d].view(np.int64))]
                yield pd.DataFrame(out, columns=["i", "value"])

    salted = items.mapInPandas(of_items, f"value bigint, k {item_kind}").select("value", "k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    seen = docs.mapInPandas(of_docs, f"i {kind}, value bigint").withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int"))
    pairs = seen.join(salted, ["value", "salt"]).select("i", "k").distinct()
    rows = pairs.join(items.select("k", F.col("t").alias("item_text")), "k").join(docs, "i")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, Item] = {}
        for pdf in batches:
            out = []
            for i, t, k, item_text in zip(pdf["i"], pdf["t"], pdf["k"], pdf["item_text"]):
                if len(known) > 2000:
                    known.clear()
                item = known.get((k, item_text)) or known.setdefault((k, item_text), Item(k, item_text, share))
                own = shingle_hashes(_codes(t))
                found = judged(item, own, np.sort(own), lambda: fold(t))  # noqa: B023
                if found:
                    out.append((i, k, *found))
            yield pd.DataFrame(out, columns=["i", "item", "containment", "run_words", "errors"])

    return rows.mapInPandas(judge, schema)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(id, item_id, containment, run_words, errors) of each document and each item that leaked into it. Null ids have no rows."""
    schema = f"i {docs.schema[id_col].dataType.simpleString()}, item {items.schema[item_id].dataType.simpleString()}, containment double, run_words int, errors int"
    narrow = spread(docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).where("i is not null and length(t) > 0"))
    wanted = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).where("k is not null and length(t) > 0").distinct()
    is_short = F.length(F.regexp_replace("t", r"[^\p{L}\p{N}]+", "")) < 2 * SHINGLE  # whatever lower case does to the length
    letters, short_letters = wanted.agg(F.sum(F.length("t")), F.sum(F.when(is_short, F.length("t")))).first()
    if (letters or 0) <= MOST_LETTERS:
        found = _by_broadcast(narrow, wanted, share, schema)
    else:
        if (short_letters or 0) > MOST_LETTERS:
            raise ValueError(f"more than {MOST_LETTERS} letters of items under {2 * SHINGLE} letters")
        found = _by_broadcast(narrow, wanted.where(is_short), share, schema).unionByName(_by_join(narrow, wanted.where(~is_short), share, schema))
    return found.withColumnsRenamed({"i": id_col, "item": "item_id"})
