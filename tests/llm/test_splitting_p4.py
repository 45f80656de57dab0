"""Problem 4: sizes, cover, overlap and boundaries."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import splitting as S


def _check(text, limit, overlap):
    cut = S.pieces(text, limit, overlap)
    solid = [k for k, c in enumerate(text) if not c.isspace()]
    if not solid:
        assert cut == []
        return
    assert cut[0][0] == solid[0] and cut[-1][1] == solid[-1] + 1
    assert all(0 < b - a <= limit and text[a:b] == text[a:b].strip() for a, b in cut)
    covered = set()
    for a, b in cut:
        covered.update(range(a, b))
    assert set(solid) <= covered
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert a < c and b < d and b - c <= overlap
    if len(text.strip()) <= limit:
        assert len(cut) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.;\n  Ж", max_size=400), st.integers(1, 40), st.data())
def test_pieces(text, limit, data):
    _check(text, limit, data.draw(st.integers(0, limit - 1)))


def test_boundaries():
    text = "One sentence here. Another sentence there. " * 20
    cut = S.pieces(text, 100, 20)
    assert all(text[b - 1] == "." for _, b in cut)
    assert S.pieces("x" * 1200, 500, 50) == [(0, 500), (450, 950), (900, 1200)]
    assert S.pieces(None) == [] and S.pieces("  ") == []
    with pytest.raises(ValueError):
        S.pieces("x", 10, 10)


def test_rechunk(spark):
    meta = "struct<source:string,chunk_index:int,total_chunks:int,start_char:int,end_char:int>"
    rng = random.Random(1)
    long = " ".join("word" * rng.randint(1, 4) + "." * (rng.random() < 0.2) for _ in range(300))
    rows = [
        (1, 7, 1, "short", ("s", 0, 3, 0, 5), 9), (2, 7, 1, long, ("s", 1, 3, 6, 6 + len(long)), 9), (3, 7, 1, "end", ("s", 2, 3, None, None), 9), (4, 8, 1, None, None, 9),
        (5, None, None, " ", ("s", None, None, None, None), 9), (6, 8, 2, " " * 600 + "x", ("s", 0, 1, 0, 601), 9),
    ]
    chunks = spark.createDataFrame(rows, f"chunk_id bigint, doc_id bigint, run_id bigint, text string, metadata {meta}, k int")
    out = {}
    for r in S.rechunk(chunks).collect():
        out.setdefault(r.chunk_id, []).append(r)
    assert set(out) == {1, 2, 3, 4, 5, 6}
    pieces = sorted(out[2], key=lambda r: r.piece)
    assert [(r.metadata.start_char - 6, r.metadata.end_char - 6) for r in pieces] == S.pieces(long)
    assert [r.text for r in pieces] == [long[a:b] for a, b in S.pieces(long)]
    n = len(pieces)
    assert [r.metadata.chunk_index for r in pieces] == list(range(1, n + 1))
    assert {r.metadata.total_chunks for r in pieces} == {n + 2} and out[3][0].metadata.chunk_index == n + 1
    assert out[4][0].text is None and len(out[6]) == 1
    assert [r.chunk_id for r in S.oversized_pieces(chunks).where("piece = 1").collect()] == [2]
    assert S.rechunk(chunks.limit(0)).count() == 0
