"""Problems 6 and 8: token counts against the public library, containers against their rules."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import bpe, budget, packing

tiktoken = pytest.importorskip("tiktoken")
with open(bpe.DEFAULT_FILE, "rb") as f:
    COUNTS = bpe.Counts(f.read())
LIBRARY = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=COUNTS.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_counts_are_those_of_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert COUNTS.of_text(text) == len(LIBRARY.encode_ordinary(text))


def test_known_texts():
    for text in ("Щоб отримати житлову виплату", "don't we'll 12½ ²", "a_b __ c\n\n  d\x1c", "汉字　x", "😀😀", "", " " * 3000, "x" * 5000):
        assert COUNTS.of_text(text) == len(LIBRARY.encode_ordinary(text))


def _docs(spark, n=400):
    rng = random.Random(2)
    words = "letter school bank council family address office form claim payment week лист школа банк родина адреса".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 300))), rng.choice(["a", "b", None]), rng.choice(["uk", None]), "c") for k in range(n)]
    rows += [(1001, None, "a", "uk", "c"), (1002, "", None, None, None), (1003, "word " * 3000, "a", "uk", "c"), (1004, rows[0][1], "a", "uk", "c")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, category string")


def test_budget(spark):
    rows, docs = _docs(spark, 100)
    want = Counter()
    for _, text, source, lang, category in rows:
        n = len(LIBRARY.encode_ordinary(text or ""))
        for key in (("source+lang+category", source, lang, category), ("source", source, None, None), ("lang", None, lang, None), ("category", None, None, category), ("all", None, None, None)):
            want[key] += n
    got = {(r.slice, r.source, r.lang, r.category): r.n_tokens for r in budget.token_budget(docs).collect()}
    assert got == dict(want)
    assert budget.token_budget(docs.limit(0)).where("slice <> 'all'").count() == 0


@pytest.mark.parametrize("shard", [50, 2000])
def test_packing(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    rows, docs = _docs(spark)
    capacity = 512
    got = packing.pack(docs.withColumnRenamed("source", "terms"), capacity=capacity).collect()
    fill, parts = Counter(), {}
    for r in got:
        fill[r.container] += r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
    assert max(fill.values()) <= capacity
    for doc_id, text, *_ in rows:
        n = len(LIBRARY.encode_ordinary(text or ""))
        own = sorted(parts.get(doc_id, []))
        assert sum(k for _, k in own) == n
        assert len(own) == (0 if n == 0 else 1 if n <= capacity else -(-n // capacity))
        assert [s for s, _ in own] == list(range(0, n, capacity))
    total = sum(fill.values())
    assert total / (len(fill) * capacity) > 0.9
    assert packing.pack(docs.limit(0)).count() == 0


def test_neighbours_share_containers():
    import numpy as np

    terms = [np.array([1, 2, 3]), np.array([7, 8, 9])] * 4
    shard = packing.Shard(np.array([25] * 8), terms, [np.ones(3, int)] * 8)
    assert {frozenset(w) for w in shard.pack(100)} == {frozenset({0, 2, 4, 6}), frozenset({1, 3, 5, 7})}


def test_all_terms_of_a_seed_count():
    import numpy as np

    # the seed shares only common terms with its neighbour; the 60 rarer ones are in no other item
    terms = [np.array([*range(1, 4), *range(100, 160)]), np.array([7, 8, 9, 10]), np.array([1, 2, 3, 10])]
    shard = packing.Shard(np.array([60, 40, 40]), terms, [np.ones(len(t), int) for t in terms])
    score = shard.scores(0)
    assert score[1] == 0 < score[2]
    for item in (0, 1, 2):  # the formula, term by term
        lengths = [len(t) for t in terms]
        want = 0.0
        for t in set(terms[0].tolist()) & set(terms[item].tolist()):
            f = sum(t in x for x in terms)
            idf = np.log1p((3 - f + 0.5) / (f + 0.5))
            want += idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[item] / np.mean(lengths)))
        assert np.isclose(score[item], want)
    assert [0, 2] in shard.pack(100)
