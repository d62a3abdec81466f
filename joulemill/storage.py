"""Shared-folder helpers: lineage cuts, scratch folders and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 32 << 20
FILE_BYTES = 128 << 20  # of a bucket's file, about
TASK_BYTES = 64 << 20  # of the rows that one task of a numbered exchange gets, in memory, about
SCRATCH: list[str] = []  # paths that this process has handed out and not yet released


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a missing setting is an error,
    because a folder on one machine would be lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    root = tempfile.mkdtemp(prefix="joulemill-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    SCRATCH.append(f"{shared_root(spark)}/joulemill/{label}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: short lineage, pruned re-reads,
    known size, and no recomputation when an executor goes away."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a check of the planner's size estimate, without a job; beyond the bound the planner chooses.

    The estimate never falls below the files read for the columns in use, so data that grow leave the hint behind."""
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate of ``df``, without a job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows brought together by ``keys`` before a partitioned write, so that a value's rows are in few files.

    Sizes are taken from the data: adaptive execution splits a common value over tasks of the advisory partition size and joins rare values."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def tasks_needed(df: DataFrame, target: int | None = None) -> int:
    """Number of tasks at which each holds about ``target`` bytes (``TASK_BYTES``) of rows in memory. The rows are counted, which reads no columns of plain tables.

    Files say little of it: encoded and compressed, a row may take a tenth of its place in a sort or a hash table."""
    row = df._jdf.schema().defaultSize() + 32  # with the row's header and its entry in a sort
    return max(1, -(-df.count() * row // (target or TASK_BYTES)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over as many tasks as their size in memory asks for, at least as many as there are cores: what a task then sorts, joins or groups
    stays the same as tables grow. Adaptive execution leaves a numbered exchange as it is."""
    return df.repartition(max(tasks_needed(df), df.sparkSession.sparkContext.defaultParallelism), *keys)


def bucket_number(*tables: DataFrame, target: int = FILE_BYTES) -> int:
    """Number of buckets, a power of two, at which the largest table's buckets hold about ``target`` bytes by the planner's estimate, and no more rows than a task takes.

    Tables that are joined take one number; with powers of two, tables bucketed at different times still match, as buckets can be joined."""
    need = max(max(-(-estimated_bytes(df) // target), tasks_needed(df)) for df in tables)
    return 1 << max(0, (need - 1).bit_length())


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Saves ``df`` as table ``name``, bucketed and sorted by ``key``. Rows are gathered per bucket first, so that a bucket is one file and not one for
    each task that holds some of its rows."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def release(spark: SparkSession) -> None:
    """Delete the session's scratch tables. Call it once the results that read them have been used."""
    while SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
