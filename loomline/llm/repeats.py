"""Problem 3: lines repeated across one source's documents.

Copies of a document are collapsed first: a cluster is a source and a sequence of lines,
with its number of copies and its first publication date; copies may differ in what does not
make lines different (case, digits, spaces, signs: new stamps and counters), and in lines that do not count. Each line
is then counted once for a cluster, which gives three figures for a (source, line):
documents (the copies weighted in), distinct clusters, and distinct dates.

Which lines are *found* is the project's definition, in documents. Which lines are *removed*
asks for clusters and dates as well (``MIN_CLUSTERS``, ``MIN_DATES``): the lines of an article
that is republished again and again stand in many documents of one cluster, and stay.

Everything is a partial aggregation on (source, line hash); no group is gathered, so a
source with a third of all rows is spread over all tasks. The list of repeated lines has at
most (mean lines a document) / ``min_share`` rows for a source.

Two lines are the same if their letters are equal ignoring case. Lines with fewer than
``min_letters`` letters never count. Null sources have no lines to report; null or empty
texts have no lines but count as documents; a null date is no date. A line is identified by
96 bits of hash and its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import spread

MIN_DOCS, MIN_SHARE, MIN_LETTERS = 5, 0.06, 3
#: Clusters and dates a line stands in, at least, to be removed.
MIN_CLUSTERS, MIN_DATES = 5, 2


def line_letters(line: Column) -> Column:
    """The letters of a line in lower case: what makes two lines the same."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def _key(letters: Column) -> Column:
    return F.struct(F.xxhash64(letters).alias("a"), F.hash(letters).alias("b"), F.length(letters).alias("n"))


def _keyed_lines(text: Column) -> Column:
    """array<struct<line_no, key>> of the countable lines; the letters of a line are taken once."""
    letters = F.transform(F.split(text, "\n", -1), lambda line, k: F.struct(k.cast("long").alias("line_no"), line_letters(line).alias("letters")))
    countable = F.filter(letters, lambda x: F.length(x["letters"]) >= MIN_LETTERS)
    return F.transform(countable, lambda x: F.struct(x["line_no"].alias("line_no"), _key(x["letters"]).alias("key")))


def _lines(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., line_no, key) of the countable lines."""
    # outer, as the inner form would have the optimizer repeat all of this in a filter on the number of lines
    out = docs.select(*keep, F.explode_outer(_keyed_lines(F.col("__text"))).alias("x")).where("x is not null")
    return out.select(*keep, "x.line_no", "x.key")


def _narrow(docs: DataFrame, source: str, text: str, more: dict[str, str]) -> DataFrame:
    narrow = docs.select(F.col(source).alias("__source"), F.col(text).alias("__text"), *[F.col(c).alias(f"__{k}") for k, c in more.items()])
    return spread(narrow.where(F.col("__source").isNotNull()))


def repeated_keys(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    date: str | None = "scraped_at",
    min_docs: int = MIN_DOCS,
    min_share: float = MIN_SHARE,
    min_clusters: int = 1,
    min_dates: int = 0,
) -> DataFrame:
    """(source, key, n_docs, n_clusters, n_dates, source_docs) of the excessively repeated lines."""
    narrow = _narrow(docs, source, text, {"date": date} if date else {})
    day = F.col("__date").try_cast("date") if date else F.lit(None).cast("date")
    totals = narrow.groupBy("__source").agg(F.count(F.lit(1)).alias("source_docs"))
    # the hash stands for the lines, so that texts are not shuffled
    letters = F.filter(F.transform(F.split("__text", "\n", -1), line_letters), lambda x: F.length(x) >= MIN_LETTERS)
    lettered = narrow.where(F.length("__text") > 0).select("__source", day.alias("day"), letters.alias("letters"))
    clusters = lettered.select(
        "__source", "day", F.sha2(F.array_join("letters", "\n"), 256).alias("text_id"), F.array_distinct(F.transform("letters", _key)).alias("keys")
    )
    # the same lines have the same keys: grouping by (source, lines) collapses the copies
    clusters = clusters.groupBy("__source", "text_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("day").alias("first_day"), F.first("keys").alias("keys")
    )
    counts = (
        clusters.select("__source", "copies", "first_day", F.explode("keys").alias("key"))
        .groupBy("__source", "key")
        .agg(
            F.sum("copies").alias("n_docs"),
            F.count(F.lit(1)).alias("n_clusters"),
            F.countDistinct("first_day").alias("n_dates"),
        )
        .where((F.col("n_docs") >= min_docs) & (F.col("n_clusters") >= min_clusters) & (F.col("n_dates") >= min_dates))
    )
    return counts.join(totals, "__source").where(F.col("n_docs") >= min_share * F.col("source_docs"))


def repeated_occurrences(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **limits) -> DataFrame:
    """(id, line_no) of each occurrence of an excessively repeated line."""
    keys = repeated_keys(docs, source, text, **limits).select("__source", "key")
    lines = _lines(_narrow(docs, source, text, {"id": id_col}), ["__id", "__source"])
    return lines.join(keys, ["__source", "key"], "left_semi").select(F.col("__id").alias(id_col), "line_no")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **limits) -> DataFrame:
    """Every document with its text without the repeated lines of many clusters and dates, and how many were removed.

    A document from a null source, or without a text, comes out as it is.
    """
    found = repeated_occurrences(docs, id_col, source, text, **{"min_clusters": MIN_CLUSTERS, "min_dates": MIN_DATES} | limits)
    drop = found.groupBy(F.col(id_col).alias("__drop_id")).agg(F.collect_set("line_no").alias("__drop"))
    joined = docs.join(drop, F.col(id_col) == F.col("__drop_id"), "left")
    kept = F.filter(
        F.transform(F.split(F.col(text), "\n", -1), lambda line, k: F.struct(k.cast("long").alias("k"), line.alias("line"))),
        lambda x: ~F.array_contains(F.col("__drop"), x["k"]),
    )
    clean = F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return joined.select(
        *[F.col(c) for c in docs.columns if c != text],
        clean.alias(text),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).alias("n_removed"),
    )
