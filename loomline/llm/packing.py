"""Problem 8: filling fixed-capacity containers by lexical retrieval packing.

Sizes are tokens of a public tokenizer. A text over the capacity is cut into full containers
and a rest; every other text stays whole. Documents are put in the order of two MinHashes of
their terms, so that documents with common words come to stand together, and this order is
cut into shards of ``SHARD`` documents: however many documents share a term, a shard never is
larger. Each shard holds a BM25 inverted index of its documents: the postings of every term
with their weights, idf from the frequencies in its shard. The largest unused document seeds
a window, and the index returns the unused neighbours for it by all its terms, best score
first; they fill the window greedily as long as they fit. What room is left takes the largest
unused document that fits, so little stays unused.

A shard's last containers are badly filled: what stands in containers below ``FULL`` is
ordered by other MinHashes and packed again, until one shard is left or a round saves less
than ``GAIN`` of these containers.

Null and empty texts have 0 tokens and stand in no container. Repeated rows are items of
their own, told apart by the id; ids have to be distinct.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bpe
from loomline.session import checkpointed, spread

CAPACITY = 4096
#: Documents of a shard.
SHARD = 2000
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Containers filled less are packed again, while that saves this share of them.
FULL, GAIN = 0.97, 0.02
_LETTERS = re.compile(r"[^\W\d_]")


class Shard:
    """The inverted index of a shard's items."""

    def __init__(self, sizes: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]):
        n = len(sizes)
        self.sizes, self.terms = sizes, terms
        lengths = np.array([c.sum() for c in counts], float)
        mean = max(lengths.mean(), 1.0) if n else 1.0
        owner = np.repeat(np.arange(n), [len(t) for t in terms])
        flat = np.concatenate(terms) if n else np.empty(0, np.int64)
        tf = np.concatenate(counts).astype(float) if n else np.empty(0)
        vocabulary, number = np.unique(flat, return_inverse=True)
        frequency = np.bincount(number, minlength=len(vocabulary))
        self.idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        weight = self.idf[number] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean))
        order = np.argsort(number, kind="stable")
        self.docs, self.weights = owner[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(frequency)])
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(int)
        self.numbers = [number[bounds[k] : bounds[k + 1]] for k in range(n)]

    def scores(self, item: int) -> np.ndarray:
        """BM25 of every item for the terms of one."""
        own = self.numbers[item]
        if not len(own):
            return np.zeros(len(self.sizes))
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in own]
        docs = np.concatenate([self.docs[s] for s in spans])
        return np.bincount(docs, np.concatenate([self.weights[s] for s in spans]), minlength=len(self.sizes))

    def pack(self, capacity: int) -> list[list[int]]:
        """The containers, as lists of item numbers in the order they were put in."""
        order = np.lexsort((np.arange(len(self.sizes)), -self.sizes))
        unused = np.ones(len(self.sizes), bool)
        by_size: dict[int, list[int]] = {}
        for k in order[::-1]:
            by_size.setdefault(int(self.sizes[k]), []).append(int(k))
        kinds = np.array(sorted(by_size))
        left = np.array([len(by_size[s]) for s in kinds])
        at = {int(s): k for k, s in enumerate(kinds)}
        out = []

        def take(item: int) -> int:
            unused[item] = False
            left[at[int(self.sizes[item])]] -= 1
            return capacity_left - int(self.sizes[item])

        for seed in order:
            if not unused[seed]:
                continue
            capacity_left = capacity
            capacity_left = take(int(seed))
            window = [int(seed)]
            smallest = self._smallest(kinds, left)
            if smallest is not None and smallest <= capacity_left:
                score = self.scores(int(seed))
                near = np.flatnonzero(unused & (score > 0) & (self.sizes <= capacity_left))
                for item in near[np.lexsort((near, -score[near]))].tolist():
                    if self.sizes[item] <= capacity_left:
                        capacity_left = take(item)
                        window.append(item)
            # what no neighbour fills takes the largest items that fit
            while True:
                k = int(np.searchsorted(kinds, capacity_left, side="right")) - 1
                fits = np.flatnonzero(left[: k + 1]) if k >= 0 else []
                if not len(fits):
                    break
                item = next(i for i in by_size[int(kinds[fits[-1]])] if unused[i])
                capacity_left = take(item)
                window.append(item)
            out.append(window)
        return out

    @staticmethod
    def _smallest(kinds: np.ndarray, left: np.ndarray) -> int | None:
        there = np.flatnonzero(left)
        return int(kinds[there[0]]) if len(there) else None


_ITEM = "id {id}, part int, token_start bigint, size int, terms array<int>, counts array<int>"


def items(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = bpe.DEFAULT_FILE) -> DataFrame:
    """(id, part, token_start, size, terms, counts): each text, or the full containers and the rest of one over the capacity."""
    data = bpe.broadcast_file(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = bpe.worker_counts(data)
        names: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["i"], pdf["t"]):
                if not t:
                    continue
                frequencies = Counter(bpe.pieces(t))
                n = known.of_pieces(frequencies)
                words: Counter[int] = Counter()
                for piece, m in frequencies.items():
                    h = names.get(piece)
                    if h is None:
                        if len(names) > 400_000:
                            names.clear()
                        word = piece.strip().lower()
                        h = names[piece] = crc32(word.encode("utf-8", "replace")) - 2**31 if _LETTERS.search(word) else 2**31
                    if h != 2**31:
                        words[h] += m
                terms, counts = list(words), list(words.values())
                for part, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    full = size == capacity  # needs no neighbours
                    rows.append((i, part, start, size, [] if full else terms, [] if full else counts))
            yield pd.DataFrame(rows, columns=["id", "part", "token_start", "size", "terms", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = spread(docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")))
    return narrow.mapInPandas(run, _ITEM.format(id=kind))


def _pack_shards(rows: DataFrame, n: int, capacity: int, level: int) -> DataFrame:
    """(container, position, fill, item columns) of the items packed in shards of neighbours by MinHash."""
    schema = f"container string, position int, fill int, {_ITEM.format(id=rows.schema['id'].dataType.simpleString())}"
    columns = ["id", "part", "token_start", "size", "terms", "counts"]

    def packed(name: str, items: pd.DataFrame) -> pd.DataFrame:
        as_arrays = lambda c: [np.asarray(x, np.int64) for x in items[c]]
        shard = Shard(items["size"].to_numpy(np.int64), as_arrays("terms"), as_arrays("counts"))
        windows = shard.pack(capacity)
        out = items.iloc[[k for w in windows for k in w]].reset_index(drop=True)
        fills = [int(shard.sizes[w].sum()) for w in windows]
        out.insert(0, "container", [f"{name}-{k}" for k, w in enumerate(windows) for _ in w])
        out.insert(1, "position", [p for w in windows for p in range(len(w))])
        out.insert(2, "fill", [f for f, w in zip(fills, windows) for _ in w])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, shards, waiting, held = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            waiting.append(pdf[columns])
            held += len(pdf)
            while held >= SHARD:
                every = pd.concat(waiting, ignore_index=True)
                yield packed(f"{level}-{task}-{shards}", every.iloc[:SHARD].reset_index(drop=True))
                waiting, held, shards = [every.iloc[SHARD:]], held - SHARD, shards + 1
        if held:
            yield packed(f"{level}-{task}-{shards}", pd.concat(waiting, ignore_index=True))

    least = lambda seed: F.coalesce(F.array_min(F.transform("terms", lambda t: F.xxhash64(t, F.lit(seed)))), F.lit(0))
    shards = math.ceil(n / SHARD)
    tasks = max(1, math.ceil(shards / 8), min(shards, 2 * rows.sparkSession.sparkContext.defaultParallelism))
    order = ["__a", "__b", "id", "part"]  # the id divides what has the same terms
    ordered = rows.withColumns({"__a": least(2 * level), "__b": least(2 * level + 1)}).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return ordered.select(*columns).mapInPandas(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = bpe.DEFAULT_FILE) -> DataFrame:
    """(container, position, id, part, token_start, n_tokens): every text once, no container over the capacity."""
    rows = checkpointed(items(docs, id_col, text, capacity, vocabulary))
    full = rows.where(F.col("size") == capacity).select(
        F.concat(F.lit("full-"), F.col("id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"),
        F.lit(0).alias("position"), "id", "part", "token_start", "size",
    )
    open_rows = rows.where(F.col("size") < capacity)
    n, before, level = open_rows.count(), math.inf, 0
    done = [full]
    while n:
        packed = checkpointed(_pack_shards(open_rows, n, capacity, level))
        bad = packed.where(F.col("fill") < FULL * capacity)
        left, containers = bad.agg(F.count(F.lit(1)), F.count_if(F.col("position") == 0)).first()
        if n <= SHARD or containers > (1 - GAIN) * before:
            done.append(packed.select(*full.columns))
            break
        done.append(packed.where(F.col("fill") >= FULL * capacity).select(*full.columns))
        open_rows, n, before, level = bad.select("id", "part", "token_start", "size", "terms", "counts"), left, containers, level + 1
    out = reduce(DataFrame.unionByName, done)
    return out.select("container", "position", F.col("id").alias(id_col), "part", "token_start", F.col("size").alias("n_tokens"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_items, n_tokens, least_containers, fill): how much of the containers is used."""
    sizes = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("items"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest")
    ).select(
        "n_containers", "n_items", "n_tokens", "fullest",
        F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("fill"),
    )
