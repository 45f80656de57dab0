"""Problem 9: recall and precision on passages with a known share and known errors."""

import random

from loomline.llm import leakage as L

VOCABULARY = [f"{a}{b}{c}" for a in ("wind", "gard", "let", "osc", "мар", "піл", "стор") for b in ("ar", "ен", "ol", "ут") for c in ("em", "ist", "ова", "ик")]


def _items(rng, n=30):
    return [(k, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(45, 95))) + ".") for k in range(n)]


def _passage(rng, words, share, errors):
    n = max(2, round(share * len(words)))
    start = rng.randint(0, len(words) - n)
    out = words[start : start + n]
    for k in rng.sample(range(1, n - 1), errors):
        out[k] = "інколи" if rng.random() < 0.7 else ""
    return [w for w in out if w]


def _disguise(rng, words):
    style = rng.randint(0, 4)
    if style == 0:
        return "".join(words)
    if style == 1:
        return " ".join(words).upper()
    if style == 2:
        return "\n".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5))
    if style == 3:
        return " ​".join(words)
    return ", ".join(words)


def test_found(spark):
    rng = random.Random(11)
    items = _items(rng)
    filler = lambda n: " ".join(rng.choice("the of letter bank school form week and для рада лист що".split()) for _ in range(n))
    rows, want, never = [], set(), set()
    for k in range(240):
        item, text = items[k % len(items)]
        words = text.rstrip(".").split()
        kind = k % 4
        if kind == 0:  # a long passage with few errors
            part = _passage(rng, words, rng.uniform(0.55, 1.0), rng.randint(0, 2))
            want.add((k, item))
        elif kind == 1:  # one that barely counts, without errors
            part = _passage(rng, words, 0.45, 0)
            want.add((k, item))
        elif kind == 2:  # too short
            part = _passage(rng, words, 0.25, 0)
            never.add((k, item))
        else:  # every third word changed
            part = [("або" if n % 3 == 2 else w) for n, w in enumerate(words)]
            never.add((k, item))
        before, after = filler(rng.randint(0, 800)), filler(rng.randint(0, 800))
        rows.append((k, f"{before} {_disguise(rng, part)} {after}"))
    rows += [(900, None), (901, ""), (902, "short"), (903, filler(30_000)), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "'x' AS i")
    table = spark.createDataFrame([*items, (99, None), (98, ""), (5, items[5][1])], "item_id bigint, text string")
    got = [(r.doc_id, r.item_id) for r in L.leaks(docs, table).collect()]
    assert set(got) >= want and not set(got) & never
    assert got.count((0, 0)) == 2  # a repeated document
    assert L.leaks(docs.limit(0), table).count() == 0 and L.leaks(docs, table.limit(0)).count() == 0


def test_joined_minima_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [*_items(rng, 8), (70, "Who won?"), (71, "a b")]
    rows = [(k, t) for k, t in items] + [(100, "Nobody knows who won, they said."), (100, "who  WON"), (101, "he won who"), (None, items[0][1]), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame([*items, (None, "Who won?")], "item_id bigint, text string")
    whole = sorted((r.doc_id, r.item_id, r.run_words, r.errors) for r in L.leaks(docs, table).collect())
    monkeypatch.setattr(L, "MOST_LETTERS", 100)
    assert sorted((r.doc_id, r.item_id, r.run_words, r.errors) for r in L.leaks(docs, table).collect()) == whole
    assert {(d, i) for d, i, _, _ in whole if i < 70} == {(k, k) for k in range(8)}
    assert [(d, i) for d, i, _, _ in whole if i == 70] == [(70, 70), (100, 70), (100, 70)]  # an item shorter than a shingle


def test_passages_that_barely_count_with_all_their_errors():
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice(VOCABULARY if rng.random() < 0.6 else ["also", "the", "for", "week"]) for _ in range(rng.randint(45, 95)))) for k in range(60)]
    texts = []
    for _, text in items:
        words = text.split()
        n = -(-2 * len(words) // 5)
        start = rng.randint(0, len(words) - n)
        part = words[start : start + n]
        for k in range(n // 8):
            part[8 * k + 4] = "zqxj"
        texts.append("school form week " + " ".join(part) + " letter bank")
    index = L.Index(items)
    found = {(d, item) for d, item, _, _, _ in index.leaks(texts)}
    assert {(d, item) for d, (item, _) in enumerate(items)} <= found


def _edge(rng, items, share):
    """Passages of just the share of the words, one word in eight changed, missing or added at any place."""
    texts = []
    for _, text in items:
        words = text.split()
        n = -(-int(share * 100) * len(words) // 100)
        start = rng.randint(0, len(words) - n)
        part = words[start : start + n]
        for k in sorted(rng.sample(range(1, n - 1), n // 8), reverse=True):
            part[k : k + 1] = rng.choice(([], ["zqxj"], [part[k], "zqxj"]))
        texts.append("school form week " + " ".join(part) + " letter bank")
    return texts


def test_recall_at_the_edge_of_the_definition():
    """Items of short words (2 to 6 letters) and of long ones, errors anywhere."""
    rng = random.Random(5)
    short = [(k, " ".join("".join(rng.choice("abcdefghijklmnoprstuvy") for _ in range(rng.randint(2, 6))) for _ in range(100))) for k in range(120)]
    for items, share, least in ((short, 0.4, 0.93), (short, 0.44, 0.98), (_items(rng, 120), 0.4, 0.97), (_items(rng, 120), 0.44, 0.99)):
        found = {(d, item) for d, item, _, _, _ in L.Index(items).leaks(_edge(rng, items, share))}
        assert sum((d, k) in found for d, (k, _) in enumerate(items)) >= least * len(items)


def test_passages_below_the_share_do_not_count():
    rng = random.Random(6)
    items = _items(rng, 60)
    assert not L.Index(items).leaks(_edge(rng, items, 0.33))


def test_least_left_is_a_lower_bound():
    assert L.least_left([4] * 20, 0.4) == (32 - 4 - 22, 28)  # eight words, one of them changed
    assert L.least_left([6, 6], 1.0) == (1, 12)
