"""Problem 6: the token budget by source, language and category.

Counting is a map stage over (id, text): the grouping columns never travel to Python beyond
what the roll-up needs, and the roll-up is a partial aggregation of exact sums by grouping
sets, so no slice, however large, is gathered. Null texts have 0 tokens; null keys form
their own slices, told from totals by ``slice``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bpe
from loomline.session import spread


def with_tokens(docs: DataFrame, text: str = "text", vocabulary: str = bpe.DEFAULT_FILE, name: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each text."""
    data = bpe.broadcast_file(docs.sparkSession, vocabulary)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        counts = bpe.worker_counts(data)
        return texts.map(lambda t: counts.of_text(t) if isinstance(t, str) else 0).astype("int64")

    return docs.withColumn(name, count(F.col(text)))


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = bpe.DEFAULT_FILE) -> DataFrame:
    """(id, n_tokens) of each document."""
    return with_tokens(spread(docs.select(id_col, text)), text, vocabulary).select(id_col, "n_tokens")


def token_budget(docs: DataFrame, keys: tuple[str, str, str] = ("source", "lang", "category"), text: str = "text", vocabulary: str = bpe.DEFAULT_FILE) -> DataFrame:
    """(slice, *keys, n_docs, n_tokens, n_chars): each combination of the keys, each key alone, and the total."""
    counted = with_tokens(spread(docs.select(*keys, text)), text, vocabulary)
    counted = counted.select(*keys, "n_tokens", F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"))
    sets = [[F.col(k) for k in keys], *[[F.col(k)] for k in keys], []]
    named = "+".join(keys)
    bits = F.grouping_id(*keys)
    names = F.when(bits == 0, named).when(bits == 3, keys[0]).when(bits == 5, keys[1]).when(bits == 6, keys[2]).otherwise("all")
    return counted.groupingSets(sets, *keys).agg(
        names.alias("slice"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("chars").alias("n_chars")
    ).select("slice", *keys, "n_docs", "n_tokens", "n_chars")
