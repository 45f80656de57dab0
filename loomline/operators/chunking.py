"""Chunking: fixed windows, packed sentences and packed paragraphs.

Fixed windows are native. Packing finds chunk bounds by bisection in the prefix sums of the
parts' lengths, in an Arrow function that sees one document at a time, so no group is gathered. Positions count
code points of the cleaned text; those of packed chunks are approximate, as overlap and
long sentences shift them (long sentences give positions inside the sentence).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import clean_text
from loomline.session import checkpointed, spread

SIZE, OVERLAP = 500, 50
STRATEGIES = ("fixed", "sentence", "paragraph")
_CUT = re.compile(r"(?<=[.!?…])\s+(?=[А-ЯІЇЄҐA-Z])")
_BLANK = re.compile(r"\n\s*\n")
_CHUNKS = "array<struct<text:string,start_char:int,end_char:int>>"


def check(size: int, overlap: int) -> None:
    if overlap >= size or overlap < 0:
        raise ValueError("overlap has to be less than the chunk size")


def fixed_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` every ``size - overlap`` characters, stripped; blank ones are left out."""
    check(size, overlap)
    length = F.length(text)
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(size - overlap)))
    windows = F.transform(
        starts,
        lambda s: F.struct(
            F.trim(F.substring(text, s + 1, F.lit(size))).alias("text"), s.alias("start_char"), F.least(s + size, length).alias("end_char")
        ),
    )
    return F.filter(windows, lambda w: w["text"] != "")


def _fixed(text: str, size: int, overlap: int) -> list[tuple[str, int, int]]:
    windows = ((text[s : s + size].strip(), s, min(s + size, len(text))) for s in range(0, len(text), size - overlap))
    return [w for w in windows if w[0]]


def _short_runs(parts: list[str], size: int) -> Iterator[tuple[list[str], str | None]]:
    """Each run of parts that fit the size, with the oversized part behind it (None at the end)."""
    run: list[str] = []
    for part in parts:
        if len(part) <= size:
            run.append(part)
        else:
            yield run, part
            run = []
    yield run, None


def _ranges(parts: list[str], size: int, overlap: int, gap: int, glued: bool) -> list[tuple[int, int, int]]:
    """(first, end, shift) of the chunks of a run: bounds found by bisection in the prefix sums of the lengths.

    Each part weighs its length and a ``gap``. A chunk takes parts up to the last prefix sum
    within the size, always one part no chunk has had; the next begins early enough to repeat
    what fits the overlap. ``shift`` is where the chunk begins, counted from the run's start:
    overlap is measured with its gaps if ``glued`` (sentences: any number of them), without
    if not (paragraphs: the last one), so each step falls short by the gap it cannot see.
    """
    sums = [0, *accumulate(len(p) + gap for p in parts)]
    out: list[tuple[int, int, int]] = []
    first = fresh = shift = room = 0
    while fresh < len(parts):
        end = max(bisect_right(sums, sums[first] + size + room) - 1, fresh + 1)
        out.append((first, end, shift))
        if glued:
            following = max(first, bisect_left(sums, sums[end] - gap - overlap, hi=end))
            room, lost = 0, gap
        else:
            following = end - 1 if len(parts[end - 1]) <= overlap else end
            room = gap * (end - following)
            lost = gap - room
        shift += sums[following] - sums[first] - lost
        first, fresh = following, end
    return out


def _pack(parts: list[str], size: int, overlap: int, glue: str, cut) -> list[tuple[str, int, int]]:
    """Chunks of whole parts; ``cut`` divides a part over the size, whose last piece is where positions go on."""
    out: list[tuple[str, int, int]] = []
    start = 0
    for run, oversized in _short_runs(parts, size):
        for first, end, shift in _ranges(run, size, overlap, len(glue), glue == " "):
            text = glue.join(run[first:end])
            out.append((text, start + shift, start + shift + len(text)))
        if oversized is not None:
            out += (pieces := cut(oversized, size, overlap))
            start = pieces[-1][2]
    return out


def pack_sentences(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(text, start, end) of chunks of whole sentences; a sentence over the size is cut into windows."""
    return _pack([s for s in map(str.strip, _CUT.split(text)) if s], size, overlap, " ", _fixed)


def pack_paragraphs(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """Chunks of whole paragraphs; one over the size is packed by sentences, the last carries over if it fits the overlap."""
    return _pack([p for p in map(str.strip, _BLANK.split(text)) if p], size, overlap, "\n\n", pack_sentences)


def packed_chunks(text: Column, strategy: str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    check(size, overlap)
    pack = {"sentence": pack_sentences, "paragraph": pack_paragraphs}[strategy]

    @F.pandas_udf(_CHUNKS)
    def run(texts: pd.Series) -> pd.Series:
        names = ("text", "start_char", "end_char")
        return texts.map(lambda t: [dict(zip(names, c)) for c in pack(t, size, overlap)] if isinstance(t, str) else None)

    return run(text)


def chunk_documents(docs: DataFrame, text: str = "text", strategy: str = "sentence", size: int = SIZE, overlap: int = OVERLAP, keep_newlines: bool = False, order: list[str] | None = None) -> DataFrame:
    """One row a chunk: the other columns, text, chunk_index, total_chunks, start_char, end_char. Blank texts have none.

    With an ``order`` of the documents each chunk also carries its document's ordinal, document_index.
    """
    check(size, overlap)
    if order:
        docs = with_ordinal(docs, order)
    other = [c for c in docs.columns if c != text]
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy has to be one of {STRATEGIES}")
    # a column of its own: inside the windows the cleaning would be done again for each of them
    clean = spread(docs).withColumn("__clean", F.trim(text) if keep_newlines else clean_text(F.col(text)))
    cut = clean.withColumn("__chunks", fixed_chunks(F.col("__clean"), size, overlap) if strategy == "fixed" else packed_chunks(F.col("__clean"), strategy, size, overlap))
    # outer, as the inner form has the optimizer push a test of the chunks' number, and with it all the work, below the scan's filter
    out = cut.select(*other, F.size("__chunks").alias("total_chunks"), F.posexplode_outer("__chunks").alias("chunk_index", "__c")).where("__c is not null")
    return out.select(*other, F.col("__c.text").alias(text), "chunk_index", "total_chunks", "__c.start_char", "__c.end_char")


def with_ordinal(df: DataFrame, order: list[str], name: str = "document_index") -> DataFrame:
    """A gapless number from 0 in the given order, without one task seeing all rows.

    Rows are range-partitioned and numbered within their partition; the sizes of the
    partitions, one number each, give the offsets. The numbered rows are written once: run
    twice, a range partitioning may cut at other places.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = checkpointed(ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33)))
    sizes = numbered.groupBy("__p").count()
    offsets = sizes.select("__p", F.coalesce(F.expr("sum(count) over (order by __p rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("__o"))
    joined = numbered.join(F.broadcast(offsets), "__p")  # one row a partition
    return joined.withColumn(name, F.col("__o") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__p", "__o")
