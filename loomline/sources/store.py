"""A vector collection as a Parquet table: create, describe, upsert, search, drop; and run artefacts as JSON.

Points are partitioned by a hash of their id, so an upsert rewrites only the partitions its
ids fall into, and a filter on metadata reaches the scan. The dimension is kept beside the
data; vectors of another length are refused.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.ingest import latest
from loomline.operators.vector import THRESHOLD, TOP_K, top_k
from loomline.session import checkpointed

BUCKETS = 64


class Collection:
    """Points (point_id, embedding, text, metadata columns) under one path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._meta = jvm.org.apache.hadoop.fs.Path(self.path + "/_collection.json")
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._meta)

    def create(self, dimensions: int) -> bool:
        """Makes an empty collection; False if there is one."""
        if self.exists():
            return False
        out = self._fs.create(self._meta, False)
        out.write(bytearray(json.dumps({"dimensions": dimensions, "distance": "cosine", "buckets": self.buckets}).encode()))
        out.close()
        return True

    def drop(self) -> bool:
        return self._fs.delete(self._at, True)

    def settings(self) -> dict:
        stream = self._fs.open(self._meta)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def points(self) -> DataFrame | None:
        """The table, None before the first upsert."""
        parts = self._fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path + "/bucket=*"))
        if parts is None or not len(parts):
            return None
        return self.spark.read.parquet(self.path)

    def upsert(self, new: DataFrame, order: list[str] | None = None) -> None:
        """Puts points over those of the same id; points without a vector or text are skipped, within the batch the last wins."""
        if not self.exists():
            raise ValueError("no such collection")
        dimensions = self.settings()["dimensions"]
        good = new.where(F.col("embedding").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != ""))
        checked = good.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(F.raise_error(F.lit("vector of another length"))))
        fresh = latest(checked, ["point_id"], order or ["text"])
        bucket = F.pmod(F.xxhash64("point_id"), F.lit(self.buckets)).cast("int")
        fresh = checkpointed(fresh.withColumn("bucket", bucket))
        now = self.points()
        if now is not None:
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            kept = now.where(F.col("bucket").isin(touched)).join(fresh.select("point_id"), "point_id", "left_anti")
            fresh = checkpointed(kept.unionByName(fresh, allowMissingColumns=True))
        writer = fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path)

    def describe(self) -> dict:
        if not self.exists():
            return {"status": "collection_not_found", "n_points": 0, "dimensions": 0}
        now = self.points()
        return {"status": "healthy", "n_points": 0 if now is None else now.count(), "dimensions": self.settings()["dimensions"]}

    def search(self, queries: DataFrame, k: int = TOP_K, threshold: float | None = THRESHOLD, where: dict | None = None) -> DataFrame | None:
        """(query_id, point_id, score, rank); equality filters reach the scan before the k are taken."""
        now = self.points()
        if now is None:
            return None
        for name, value in (where or {}).items():
            now = now.where(F.col(name) == F.lit(value))
        return top_k(now.withColumnRenamed("point_id", "vec_id"), queries, k, threshold).withColumnRenamed("vec_id", "point_id")


def write_run(docs: DataFrame, chunks: DataFrame, statistics: DataFrame, folder: str, stamp: str) -> None:
    """The artefacts of a run: documents, chunks and one row of statistics, as JSON."""
    for name, df in (("documents", docs), ("chunks", chunks), ("stats", statistics)):
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}_{stamp}")
