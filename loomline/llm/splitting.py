"""Problem 4: splitting oversized items at natural boundaries.

For one text, token offsets are taken once as prefix sums (the start and end of every
token), and each kind of natural boundary (paragraph, line, sentence, clause, word) becomes
one sorted array of token ends. A piece starting at ``s`` ends at the last boundary not
beyond ``s + limit``, found by binary search, of the best kind that fills at least
``fill`` of the limit; any word boundary serves next, and a hard cut is the fallback inside
a token longer than the limit. The next piece starts at the first token at or after
``end - overlap``, so consecutive pieces share at most ``overlap`` characters; after a hard
cut exactly ``overlap`` are shared.

Sizes are Unicode code points; white space at both ends of an item or piece is not counted.
Null and blank texts have no pieces, and a text within the limit is its one piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import spread

LIMIT, OVERLAP, FILL = 500, 50, 0.5
_TOKEN = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?…][\"'»”’)\]]*$")
_CLAUSE_END = re.compile(r"[;:,—–)][\"'»”’)\]]*$|^[—–-]$")
#: White space Spark's trim has to take off at both ends.
_ENDS = r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$"


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, without white space at their ends."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("needs 0 <= overlap < limit")
    spans = [m.span() for m in _TOKEN.finditer(text or "")]
    if not spans:
        return []
    starts = [a for a, _ in spans]
    ends = [b for _, b in spans]
    last = ends[-1]
    if last - starts[0] <= limit:
        return [(starts[0], last)]
    levels: list[list[int]] = [[], [], [], []]
    for k, (a, b) in enumerate(spans):
        gap = text[b : starts[k + 1]] if k + 1 < len(spans) else ""
        if "\n" in gap:
            levels[0 if gap.count("\n") > 1 else 1].append(b)
        tail = text[max(a, b - 6) : b]
        if _SENTENCE_END.search(tail):
            levels[2].append(b)
        elif _CLAUSE_END.search(tail):
            levels[3].append(b)
    out, s, reached = [], starts[0], 0
    while True:
        most = s + limit
        if last <= most:
            out.append((s, last))
            return out
        e = 0
        for array in levels:
            k = bisect_right(array, most) - 1
            if k >= 0 and array[k] >= s + fill * limit and array[k] > reached:
                e = array[k]
                break
        if not e:
            k = bisect_right(ends, most) - 1
            if k >= 0 and ends[k] > max(s, reached):
                e = ends[k]
        if e:
            # the first token of the overlap; it lies after s, so that every piece moves on
            out.append((s, e))
            s, reached = starts[bisect_left(starts, max(e - overlap, s + 1))], e
        elif s < (fresh := starts[bisect_right(ends, reached)]) and fresh >= reached:
            s = fresh  # the overlap leaves no room for the next token
        else:  # a token longer than the limit
            out.append((s, most))
            s, reached = most - overlap, most


def trimmed_length(text: Column) -> Column:
    """Code points without the white space at both ends."""
    return F.length(F.regexp_replace(text, _ENDS, ""))


def _udf(limit: int, overlap: int):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in pieces(t, limit, overlap)] if isinstance(t, str) else None)

    return run


def split_oversized(chunks: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Each row with ``pieces``: its cuts if it is over the limit, else null.

    Only texts over the limit travel to Python. The length test is native: the cheap
    ``length > limit`` comes first, as it holds for every text that is over.
    """
    over = (F.length(F.col(text)) > limit) & (trimmed_length(F.col(text)) > limit)
    return chunks.withColumn("pieces", _udf(limit, overlap)(F.when(over, F.col(text))))


def oversized_pieces(chunks: DataFrame, id_col: str = "chunk_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, start, end) of the items over the limit only; a map stage that reads two columns."""
    over = chunks.where((F.length(text) > limit) & (trimmed_length(F.col(text)) > limit)).select(F.col(id_col).alias("__id"), F.col(text).alias("__t"))
    cut = spread(over).select("__id", _udf(limit, overlap)("__t").alias("p"))
    # outer, so that the optimizer does not repeat the cutting in a filter on the number of pieces
    return cut.select(F.col("__id").alias(id_col), F.posexplode_outer("p").alias("piece", "x")).where("x is not null").select(id_col, "piece", "x.start", "x.end")


def rechunk(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All items as pieces within the limit, with new chunk_index, total_chunks, start_char and end_char.

    Numbers run through each document of an ingest run in the old order (chunk_index, then
    chunk_id; a null index comes first). Positions are the old start plus the offset inside
    the item. Blank items stay as they are, as one piece. Documents are the only groups.
    """
    whole = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    needed = chunks.select("chunk_id", "doc_id", "run_id", "text", "metadata")
    cut = split_oversized(needed, "text", limit, overlap).withColumn("pieces", F.coalesce("pieces", whole))
    group = Window.partitionBy("doc_id", "run_id")
    before = group.orderBy("metadata.chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("n", F.size("pieces")).withColumns(
        {"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(group)}
    )
    out = numbered.select("*", F.posexplode_outer("pieces").alias("k", "p"))
    cut_text = F.when(F.col("p.start").isNull(), F.col("text")).otherwise(F.expr("substring(text, p.start + 1, p.end - p.start)"))
    start = F.coalesce(F.col("metadata.start_char"), F.lit(0))
    new = {
        "chunk_index": (F.col("first") + F.col("k")).cast("int"),
        "total_chunks": F.col("total").cast("int"),
        "start_char": F.when(F.col("p.start").isNull(), F.col("metadata.start_char")).otherwise(start + F.col("p.start")).cast("int"),
        "end_char": F.when(F.col("p.start").isNull(), F.col("metadata.end_char")).otherwise(start + F.col("p.end")).cast("int"),
    }
    metadata = F.col("metadata")
    for name, value in new.items():
        metadata = metadata.withField(name, value)
    return out.select("chunk_id", "doc_id", "run_id", F.col("k").alias("piece"), cut_text.alias("text"), metadata.alias("metadata"))
