"""Retrieval: hits with their documents, age filter, date order, context, sources and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.dates import display_date, document_date, is_recent
from loomline.functions.text import snippet

NO_CONFIDENCE, UNSCORED = 0.0, 0.7


def context_block(index: Column, text: Column, source: Column, title: Column, url: Column, date: Column) -> Column:
    """One numbered document of a context."""
    part = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(name), value)).otherwise("")
    return F.concat(
        F.lit("[Документ "), index.cast("string"), F.lit("]"), part(" - ", title), F.lit("\nДжерело: "), F.coalesce(source, F.lit("Unknown")),
        part("\nПосилання: ", url), part("\nДата документа: ", date), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"),
    )


def retrieve(
    hits: DataFrame, documents: DataFrame, as_of: Column | None = None, most_days: int | None = None, by_date: bool = True, header: Column | None = None
) -> DataFrame:
    """(query_id, context, sources, found_documents, confidence) from hits (query_id, doc_id, score).

    ``documents`` has doc_id, text, source, title, url, document_date. The age filter and the
    date order come after the top k, so they shrink or reorder the hits but never refill them.
    A query's hits are at most k, so collecting them is bounded.
    """
    rows = hits.join(documents, "doc_id")
    if most_days is not None:
        rows = rows.where(is_recent(F.col("document_date"), as_of, most_days))
    date = F.coalesce(document_date(F.col("document_date")), F.lit("1970-01-01").cast("timestamp_ntz"))
    first = -F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), date) if by_date else F.lit(0).cast("bigint")
    item = F.struct(
        first.alias("a"), (-F.col("score")).alias("b"), F.col("doc_id").alias("c"), "text", "source", "title", "url", display_date(F.col("document_date")).alias("date"), "score"
    )
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("hits"), F.avg("score").alias("mean"))
    blocks = F.transform("hits", lambda h, k: context_block(k + 1, h["text"], h["source"], h["title"], h["url"], h["date"]))
    context = F.array_join(blocks, "\n")
    if header is not None:
        context = F.concat(header, F.lit("\n\n"), context)
    sources = F.transform("hits", lambda h: F.struct(snippet(h["text"]).alias("text"), h["score"].alias("score"), h["title"].alias("title"), h["source"].alias("source"), h["url"].alias("url")))
    return grouped.select(
        "query_id", context.alias("context"), sources.alias("sources"), F.size("hits").alias("found_documents"), confidence(F.size("hits"), F.col("mean")).alias("confidence")
    )


def with_empty(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Every query; those without a hit have an empty context and no sources."""
    joined = queries.join(found, "query_id", "left")
    return joined.withColumns(
        {
            "context": F.coalesce("context", F.lit("")),
            "found_documents": F.coalesce("found_documents", F.lit(0)),
            "confidence": F.coalesce("confidence", F.lit(NO_CONFIDENCE)),
        }
    )


def confidence(n: Column, mean: Column) -> Column:
    """0 without sources, the mean score up to 1, or a fixed value if none is scored."""
    return F.when(n == 0, NO_CONFIDENCE).otherwise(F.least(F.coalesce(mean, F.lit(UNSCORED)), F.lit(1.0)))


def health_state(collection) -> dict:
    """status, n_points, dimensions of a vector collection: not_initialized without one, error with its message if it cannot be read."""
    if collection is None:
        return {"status": "not_initialized", "n_points": 0, "dimensions": 0}
    try:
        return collection.describe()
    except Exception as e:  # noqa: BLE001
        return {"status": "error", "n_points": 0, "dimensions": 0, "error": f"{type(e).__name__}: {e}"}


def health(points: DataFrame, vector: str = "embedding") -> DataFrame:
    """(status, n_points, dimensions) of a collection's points."""
    return points.agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dimensions")).select(
        F.when(F.col("n_points") > 0, "healthy").otherwise("collection_not_found").alias("status"), "n_points", "dimensions"
    )
