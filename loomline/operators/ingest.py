"""Ingest: normalising, union, keyed replacement, dates of old records, statistics, migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import strip

#: Fixed value: the date given to old records whose own cannot be read.
FALLBACK_DATE = "2023-01-01"


def normalise_documents(df: DataFrame, text: str = "text", content: str = "content") -> DataFrame:
    """text, else content, stripped; rows without either are dropped."""
    value = F.coalesce(F.when(F.col(text) != "", F.col(text)), F.col(content))
    return df.withColumn(text, strip(value)).drop(content).where(F.col(text) != "")


def first_given(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows in one table; ``source_ordinal`` keeps the order of the inputs, missing columns are null."""
    numbered = [f.withColumn("source_ordinal", F.lit(k)) for k, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def ingest_statistics(docs: DataFrame, chunks: DataFrame, official: str, community: str, errors: int = 0) -> DataFrame:
    """One row: documents by kind, chunks, errors, success. No document means failure.

    ``docs`` has document_type and source, ``chunks`` text and whether it was ``stored``.
    """
    scraped = F.coalesce(F.col("document_type"), F.lit("")) != "manual"
    d = docs.agg(
        F.count(F.lit(1)).alias("documents_loaded"),
        F.count_if(~scraped).alias("manual_documents"),
        F.count_if(scraped & (F.col("source") == official)).alias("official_documents"),
        F.count_if(scraped & (F.col("source") == community)).alias("community_documents"),
    )
    c = chunks.agg(F.count(F.lit(1)).alias("chunks_created"), F.count_if("stored").alias("chunks_stored"))
    # two one-row tables side by side
    return d.withColumn("__k", F.lit(1)).join(c.withColumn("__k", F.lit(1)), "__k").drop("__k").withColumns(
        {"errors": F.lit(errors), "success": (F.col("documents_loaded") > 0) & F.lit(errors == 0)}
    )


def length_statistics(chunks: DataFrame, by: list[str] | None = None, text: str = "text") -> DataFrame:
    return chunks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length(text)), 6).alias("mean"), F.min(F.length(text)).alias("least"), F.max(F.length(text)).alias("most")
    )


def consistent_runs(stats: DataFrame) -> DataFrame:
    """Run statistics with the older form folded in; what a failed run claims to have stored counts as 0."""
    return stats.withColumns(
        {
            "documents_loaded": F.coalesce("documents_loaded", "documents_scraped"),
            "chunks_stored": F.when(F.col("success"), F.col("chunks_stored")).otherwise(0),
        }
    ).drop("documents_scraped")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (a keyed replacement). A map-side max, so a hot key is no hot task.

    Rows with a null key are kept as they are.
    """
    unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    best = df.where(~unkeyed).groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r")).select("__r.*")
    return best.unionByName(df.where(unkeyed))


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``current`` with the rows of ``updates`` put over it; within updates the last of a key wins."""
    new = latest(updates, keys, order)
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def chunk_key(url: Column, chunk_index: Column) -> Column:
    """A stable point id, so that a later batch replaces its own chunk only."""
    return F.md5(F.concat(F.coalesce(url, F.lit("")), F.lit("\u001f"), F.coalesce(chunk_index.cast("string"), F.lit(""))))


def migrated_date(document_date: Column, last_updated: Column, as_of: Column) -> Column:
    """The document date; else a valid year-month-day update; an invalid one gives the fallback, none a year before as_of."""
    valid = last_updated.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & last_updated.try_cast("date").isNotNull()
    kept = F.when(valid, last_updated).when(last_updated.isNull(), F.date_format(F.add_months(as_of, -12), "yyyy-MM-dd")).otherwise(FALLBACK_DATE)
    return F.coalesce(document_date, kept)


def migrated_date_unchecked(last_updated: Column) -> Column:
    return F.coalesce(last_updated, F.lit(FALLBACK_DATE))


def migrated_date_by_age(document_date: Column, as_of: Column, years: int) -> Column:
    return F.coalesce(document_date, F.date_format(F.date_sub(as_of, 365 * years), "yyyy-MM-dd"))


def migrated_documents(docs: DataFrame, as_of: Column, document_date: str = "document_date", last_updated: str = "last_updated") -> DataFrame:
    """The documents of an archive as they go to the active folder: each with a document date, all else as it is."""
    return docs.withColumn(document_date, migrated_date(F.col(document_date), F.col(last_updated), as_of))


def migration_counts(before: DataFrame, date: str = "document_date") -> DataFrame:
    return before.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(date).isNull()).alias("converted"))
