"""Documents from folders of JSON, plain text and Markdown files.

Files are read whole by Spark; JSON comes in three shapes (a list, an object with
``documents``, one document) and keeps every record that can be read. Defaults fill keys
that are absent, not those that are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import first_heading, strip, title_from_name

FORMATS = {"json": "*.json", "txt": "*.txt", "markdown": "*.md"}
#: Files that are no documents.
SKIPPED = {"json": ("readme.json", "example_document.json"), "txt": (), "markdown": ("readme.md",)}
#: Well-known metadata keys.
KEYS = ("source", "file", "title", "url", "scraped_at", "document_date", "document_type", "type", "category", "language", "last_updated", "source_url", "description", "topic")
_SCHEMA = "text string, " + ", ".join(f"{k} string" for k in KEYS)


def _files(spark: SparkSession, path: str, kind: str, recursive: bool, pattern: str | None) -> DataFrame:
    files = (
        spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern or FORMATS[kind]).text(path, wholetext=True)
        .select("value", "_metadata.file_name", "_metadata.file_path", F.col("_metadata.file_modification_time").alias("modified"))
    )
    return files.where(~F.lower("file_name").isin(*SKIPPED[kind])) if SKIPPED[kind] else files


def _key(doc: Column, key: str, otherwise: Column) -> Column:
    """A string key of the metadata; the default where it is absent, null where it is null."""
    there = F.array_contains(F.json_object_keys(F.get_json_object(doc, "$.metadata")), key)
    return F.when(F.coalesce(there, F.lit(False)), F.get_json_object(doc, f"$.metadata.{key}")).otherwise(otherwise)


def json_documents(files: DataFrame, as_of: str | None = None) -> DataFrame:
    """(well-known keys, text, file_path) of files (value, file_name, file_path, modified)."""
    whole = F.trim(files["value"])
    listed = F.when(whole.startswith("["), whole).when(F.get_json_object(whole, "$.documents").isNotNull(), F.get_json_object(whole, "$.documents")).otherwise(
        F.concat(F.lit("["), whole, F.lit("]"))
    )
    readable = files.where(F.try_parse_json("value").isNotNull())
    docs = readable.withColumn("doc", F.explode_outer(F.from_json(listed, "array<string>"))).where("doc is not null")
    return _documents(docs, as_of)


def _documents(docs: DataFrame, as_of: str | None) -> DataFrame:
    doc = F.col("doc")
    top = lambda k: F.get_json_object(doc, f"$.{k}")
    text = F.coalesce(F.when(top("text") != "", top("text")), top("content"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    now = F.lit(as_of) if as_of else F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")
    path = F.regexp_replace("file_path", "^file:/*", "/")
    date = F.coalesce(
        F.get_json_object(doc, "$.metadata.document_date"), F.get_json_object(doc, "$.metadata.last_updated"), top("date"), top("document_date"), top("last_updated"),
        F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    defaults = {
        "source": F.lit("manual"), "file": F.col("file_name"), "title": F.coalesce(top("title"), stem), "url": F.coalesce(top("url"), F.concat(F.lit("file://"), path)),
        "scraped_at": now,
    }
    columns = []
    for k in KEYS:
        if k == "document_date":
            value = date
        elif k == "document_type":
            value = F.lit("manual")
        else:
            value = _key(doc, k, defaults.get(k, F.lit(None).cast("string")))
        columns.append(value.alias(k))
    return docs.select(strip(text).alias("text"), *columns).where(F.col("text") != "")


def text_documents(files: DataFrame, as_of: str | None = None, markdown: bool = False) -> DataFrame:
    """One document a file; blank files are dropped."""
    named = title_from_name(F.col("file_name"))
    title = F.coalesce(first_heading(F.col("value")), named) if markdown else named
    moment = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")
    given = {
        "source": F.lit("manual"), "file": F.col("file_name"), "title": title, "url": F.concat(F.lit("file://"), F.regexp_replace("file_path", "^file:/*", "/")),
        "scraped_at": F.lit(as_of) if as_of else moment, "document_date": moment, "document_type": F.lit("manual"), "type": F.lit("markdown" if markdown else "text"),
    }
    null = F.lit(None).cast("string")
    return files.select(strip(F.col("value")).alias("text"), *[given.get(k, null).alias(k) for k in KEYS]).where(F.col("text") != "")


def load_documents(
    spark: SparkSession, path: str, kind: str = "json", recursive: bool = True, use_active_folder: bool = False, as_of: str | None = None, pattern: str | None = None
) -> DataFrame:
    """The documents of a folder; only its ``active`` part if asked for. A missing folder or unknown kind gives no rows.

    ``pattern`` takes other file names than those of the kind.
    """
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], _SCHEMA)
    if kind not in FORMATS:
        return empty
    folder = f"{path.rstrip('/')}/active" if use_active_folder else path
    try:
        files = _files(spark, folder, kind, recursive, pattern)
    except AnalysisException:
        return empty
    return json_documents(files, as_of) if kind == "json" else text_documents(files, as_of, kind == "markdown")


def write_documents(docs: DataFrame, path: str, text: str = "text") -> None:
    """Nested JSON lines: text and metadata."""
    other = [c for c in docs.columns if c != text]
    docs.select(text, F.struct(*other).alias("metadata")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    nested = spark.read.json(path)
    return nested.select("text", "metadata.*")
