"""Problem 3 against a plain count."""

import random
import re
from collections import Counter

from loomline.llm import repeats


def _plain(rows):
    docs, lines = Counter(), {}
    for i, (_, source, text) in enumerate(rows):
        if source is None:
            continue
        docs[source] += 1
        for line in (text or "").split("\n") if text else []:
            key = "".join(c for c in line if c.isalpha()).lower()
            if len(key) >= 3:
                lines.setdefault((source, key), set()).add(i)
    hot = {k for k, v in lines.items() if len(v) >= 5 and len(v) >= 0.06 * docs[k[0]]}
    out = []
    for doc_id, source, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if (source, "".join(c for c in line if c.isalpha()).lower()) in hot:
                out.append((doc_id, n))
    return sorted(out)


def _rows():
    rng = random.Random(5)
    shared = ["© 2024 Site. Права", "Share: 12", "ab", "Теги — новини!", "rare line"]
    rows = []
    for k in range(300):
        source = "hot" if k % 3 == 0 else f"s{k % 7}"
        lines = [f"own words {chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}" for _ in range(rng.randint(0, 5))]
        lines += [re.sub(r"\d+", str(k), s).upper() if rng.random() < 0.5 else s for s in shared if rng.random() < 0.3]
        rng.shuffle(lines)
        rows.append((k, source, "\n".join(lines)))
    rows += [(k, "s1", rows[1][2]) for k in range(300, 306)]  # copies
    return rows + [(400, None, "© 2024 Site. Права"), (401, "hot", None), (402, "hot", ""), (403, "long", "x y z\n" * 5000)]


def test_found(spark):
    rows = _rows()
    docs = spark.createDataFrame([(*r, f"2024-01-{1 + r[0] % 9:02d} 00:00:00", "k", 1) for r in rows], "doc_id bigint, source string, text string, scraped_at string, key string, n_docs int")
    got = sorted((r.doc_id, r.line_no) for r in repeats.repeated_occurrences(docs).collect())
    assert got == _plain(rows) and got
    clean = {r.doc_id: (r.text, r.n_removed) for r in repeats.without_repeats(docs, min_clusters=1, min_dates=0).collect()}
    assert len(clean) == len(rows)
    removed = Counter(i for i, _ in got)
    for doc_id, _, text in rows:
        assert clean[doc_id][1] == removed[doc_id]
        if not removed[doc_id]:
            assert clean[doc_id][0] == text
    report = {(r["__source"]): (r.n_docs, r.n_clusters) for r in repeats.repeated_keys(docs).where("n_docs > n_clusters").collect()}
    assert "s1" in report  # copies are one cluster
    assert repeats.repeated_occurrences(docs.limit(0)).count() == 0


def test_a_republished_article_keeps_its_lines(spark):
    """Twelve copies of one article with new stamps, in a source whose other pages share a notice."""
    words = "river bridge letter school bank council garden winter doctor market".split()
    article = "The old bridge opens again\nIt was closed for a year.\nViews: {n}"
    rows = [(k, "s", article.format(n=k * 7), f"2024-03-{1 + k:02d}") for k in range(12)]
    rows += [(100 + k, "s", f"About the {w} and the {words[k - 3]}\nGeneral information, no advice.", f"2024-04-{1 + k:02d}") for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, scraped_at string")
    found = {(r.doc_id, r.line_no) for r in repeats.repeated_occurrences(docs).collect()}
    assert found == {(k, n) for k in range(12) for n in range(3)} | {(100 + k, 1) for k in range(10)}  # the project counts documents
    clean = {r.doc_id: (r.text, r.n_removed) for r in repeats.without_repeats(docs).collect()}
    assert all(clean[k] == (article.format(n=k * 7), 0) for k in range(12))
    assert all(clean[100 + k][1] == 1 for k in range(10))
    one_day = docs.withColumn("scraped_at", docs.scraped_at.substr(1, 0))  # without dates nothing is removed
    assert all(r.n_removed == 0 for r in repeats.without_repeats(one_day).collect())
