"""Reading tables as streams and draining streaming queries into tables in the shared folder."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from joulemill.operators.ordered import one_per_key
from joulemill.storage import scratch
from joulemill.tables import Tables


def table_stream(t: Tables, name: str, **options) -> DataFrame:
    """File stream over a table (one file or a folder of files): no copy, pruned columns."""
    path = t.path(name)
    schema = t.raw(name).schema
    reader = t.spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    df = reader.parquet(path[:-1] + f"[{path[-1]}]")  # a glob, so that a single file is accepted as well
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def event_stream(t: Tables, delay: str | None = "10 minutes", closed: bool = True) -> DataFrame:
    """The events with a watermark. ``closed`` adds one late sentinel row (user -1, a day after the end), which
    moves the watermark past every real event, so append-mode results are complete; it never leaves itself."""
    e = table_stream(t, "events").select("event_id", "ts", "user_id", "event_type", "value")
    if closed:
        path = scratch(t.spark, "sentinel")
        t.events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(
            F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"),
            F.lit("end").alias("event_type"), F.lit(0.0).alias("value")).write.parquet(path)
        e = e.unionByName(t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path))
    return e.withWatermark("ts", delay) if delay else e


@contextmanager
def state_partitions(spark):
    """State is kept per shuffle partition. A local session uses no more of them than it has cores; on a
    cluster the configured number stands."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    cores = spark.sparkContext.defaultParallelism
    if spark.sparkContext.master.startswith("local") and int(before) > cores:
        spark.conf.set(key, str(cores))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain(df: DataFrame, label: str = "sink") -> DataFrame:
    """Run an append-mode query over everything available into a Parquet table and return the table."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    with state_partitions(spark):
        df.writeStream.format("parquet").outputMode("append").option("path", path).option(
            "checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def drain_until_idle(df: DataFrame, label: str = "sink", limit_s: float = 1800.0) -> DataFrame:
    """Run an append-mode query with processing-time timers until all input is read and its state is empty.

    Triggers go on without input, which is what lets timers run out. Raises when state is left after ``limit_s`` seconds."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    with state_partitions(spark):
        q = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", path + "-state").trigger(processingTime="200 milliseconds").start()
        try:
            end = time.monotonic() + limit_s
            while not _idle(q):
                if q.exception():
                    raise q.exception()
                if time.monotonic() > end:
                    raise TimeoutError(f"state is left after {limit_s} seconds")
                time.sleep(0.1)
        finally:
            q.stop()
    return spark.read.schema(df.schema).parquet(path)


def drain_numbers(df: DataFrame, per_batch: int, last: int, label: str = "numbers", limit_s: float = 1800.0) -> DataFrame:
    """Run a query on a source that counts from 0 by ``per_batch`` numbers a batch until the batch that holds ``last`` is committed."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    needed = last // per_batch

    def write(batch: DataFrame, number: int) -> None:
        if number <= needed:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_partitions(spark):
        q = df.writeStream.foreachBatch(write).option("checkpointLocation", path + "-state").trigger(processingTime="100 milliseconds").start()
        try:
            end = time.monotonic() + limit_s
            while not (q.lastProgress and q.lastProgress["batchId"] >= needed):
                if q.exception():
                    raise q.exception()
                if time.monotonic() > end:
                    raise TimeoutError(f"batch {needed} is not done after {limit_s} seconds")
                time.sleep(0.1)
        finally:
            q.stop()
    return spark.read.schema(df.schema).parquet(path)


def _idle(q) -> bool:
    last = q.lastProgress
    return last is not None and last["batchId"] > 0 and last["numInputRows"] == 0 and not any(s["numRowsTotal"] for s in last["stateOperators"])


def drain_batches(df: DataFrame, mode: str, prepare: Callable[[DataFrame], DataFrame] | None = None, label: str = "batches") -> DataFrame:
    """Run a query and keep every batch in its own folder, so a repeated batch replaces itself.

    The returned table has the batch number in ``batch``.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)

    def write(batch: DataFrame, number: int) -> None:
        out = prepare(batch) if prepare else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_partitions(spark):
        df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", path + "-state").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", path).option("mergeSchema", True).parquet(path)


def upserted(df: DataFrame, keys: list[str], label: str = "upsert") -> DataFrame:
    """Update-mode query whose sink keeps the newest row per key."""
    rows = drain_batches(df, "update", label=label)
    return one_per_key(rows, keys, [F.col("batch")], latest=True).drop("batch")


def completed(df: DataFrame, label: str = "complete") -> DataFrame:
    """Complete-mode query: the last batch is the result."""
    rows = drain_batches(df, "complete", label=label)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").drop("batch")
