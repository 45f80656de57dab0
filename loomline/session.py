"""Session set-up, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LOOMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns and filters are pruned into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder the session names in ``spark.checkpoint.dir``.

    A session whose tasks run in the driver's own process (``local[n]``: tests, the benchmark)
    may go without the setting and gets a folder of its own. Any other session without it is
    refused: its executors would write to the disks of their own machines. Files go when the
    data frame does if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """A folder all executors share, below that of the checkpoints; see ``checkpointed``."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomline-checkpoint-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}" if name else context.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-heavy map stage at least one task for each core.

    A small input comes as one or two file splits and is moved once. Where splits already
    outnumber the cores (any input of production size) the data is not moved at all, nor
    behind a shuffle (an adaptive plan), whose partitions are sized by the session. Only the
    plan depends on this, never the rows.
    """
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *keys) if keys else df.repartition(cores * 2)


def scattered(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffled by the keys into as many partitions as the session names, for groups that cost much CPU for few bytes: adaptive plans would merge them by bytes."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
