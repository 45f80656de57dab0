"""Vector search: exact top-k by cosine with filters and thresholds.

Queries come in blocks of bounded bytes, each broadcast and one scan of the vectors, which
are never shuffled; only one block at a time is on the driver. An Arrow batch is one matrix
product; a task keeps the k best for each query over all its batches, so what is shuffled is
k rows a query and task, then ranked. Null vectors, empty ones, zero vectors and those of
another length than the query have no score. Ties go to the smaller id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import spread

TOP_K, THRESHOLD, DIMENSIONS = 5, 0.7, 1024
#: Queries searched for in one scan at most, and numbers in their vectors.
BLOCK, BLOCK_NUMBERS = 16_384, 8_000_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Native cosine of two arrays, for few pairs; null if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A deterministic stand-in for a model: hashed words and their trigrams, unit length; blank texts are null."""

    def vector(t: str | None) -> np.ndarray | None:
        words = re.findall(r"\w+", t.lower()) if isinstance(t, str) else []
        if not words:
            return None
        out = np.zeros(dimensions, np.float32)
        for w in words:
            for feature in (w, *(w[k : k + 3] for k in range(max(0, len(w) - 2)))):
                h = crc32(feature.encode("utf-8", "replace"))
                out[h % dimensions] += 1.0 if h & 0x80000000 else -1.0
        norm = np.linalg.norm(out)
        return out / norm if norm else None

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(vector)

    return run(text)


class _Best:
    """The k best of each query over the batches of a task."""

    def __init__(self, queries: list[tuple], k: int, threshold: float | None, equal: bool):
        self.k, self.equal, self.sizes = k, equal, []
        for n in sorted({len(v) for _, v, _ in queries}):
            own = [q for q in queries if len(q[1]) == n]
            matrix = np.array([q[1] for q in own], float).reshape(len(own), n)
            norms = np.linalg.norm(matrix, axis=1)
            good = np.flatnonzero(norms > 0)
            if len(good) and n:
                labels = np.array([own[g][2] for g in good], object)
                least = np.full(len(good), -np.inf if threshold is None else threshold)
                self.sizes.append((n, [own[g][0] for g in good], matrix[good] / norms[good, None], labels, least, [[] for _ in good]))

    def add(self, pdf: pd.DataFrame) -> None:
        lengths = pdf["v"].map(len).to_numpy()
        for n, _, unit, labels, least, found in self.sizes:
            at = np.flatnonzero(lengths == n)
            if not len(at):
                continue
            own = np.stack(pdf["v"].to_numpy()[at]).astype(float)
            norms = np.linalg.norm(own, axis=1)
            at, own, norms = at[norms > 0], own[norms > 0], norms[norms > 0]
            scores = (own / norms[:, None]) @ unit.T
            good = scores >= least - 1e-11  # what is equal after rounding may win by its id
            if self.equal:
                good &= pdf["e"].to_numpy()[at][:, None] == labels[None, :]
            numbers = pdf["i"].to_numpy()[at]
            for q in np.flatnonzero(good.any(axis=0)).tolist():
                rows = np.flatnonzero(good[:, q])
                found[q] += zip(scores[rows, q].tolist(), numbers[rows].tolist())
                if len(found[q]) > 4 * self.k:
                    self._cut(found, least, q)

    def _cut(self, found: list, least: np.ndarray, q: int) -> None:
        found[q].sort(key=lambda x: (-round(x[0], 12), x[1]))
        del found[q][self.k :]
        if len(found[q]) == self.k:
            least[q] = max(least[q], found[q][-1][0])

    def rows(self, threshold: float | None) -> list[tuple]:
        out = []
        for _, ids, _, _, least, found in self.sizes:
            for q, name in enumerate(ids):
                self._cut(found, least, q)
                out += [(name, i, s) for s, i in found[q] if threshold is None or s >= threshold]
        return out


def _blocks(rows: Iterator) -> Iterator[list[tuple]]:
    block, numbers = [], 0
    for r in rows:
        if block and (len(block) >= BLOCK or numbers + len(r[1]) > BLOCK_NUMBERS):
            yield block
            block, numbers = [], 0
        block.append((r[0], r[1], r[2]))
        numbers += len(r[1])
    if block:
        yield block


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    threshold: float | None = None,
    id_col: str = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    equal: str | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): for each query the k best rows with at least the threshold.

    ``equal`` names a column of both sides that has to be equal; it is tested before the k
    are taken.
    """
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_id, query_vector, (F.col(equal) if equal else F.lit(0)).alias("e")).orderBy(query_id)
    spark = vectors.sparkSession
    kind, query_kind = vectors.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"query_id {query_kind}, id {kind}, score double"
    narrow = spread(
        vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector).alias("v"), (F.col(equal) if equal else F.lit(0)).alias("e"))
    )

    def search(block: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(shared.value, k, threshold, equal is not None)
            for pdf in batches:
                best.add(pdf)
            yield pd.DataFrame(best.rows(threshold), columns=["query_id", "id", "score"])

        return narrow.mapInPandas(run, schema)

    found = [search(block) for block in _blocks(asked.toLocalIterator())]
    if not found:
        return spark.createDataFrame([], schema + ", rank int").withColumnRenamed("id", id_col)
    best = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("id", id_col)
