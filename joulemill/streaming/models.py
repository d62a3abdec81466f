"""Models that learn from a stream, one version per batch in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from joulemill.storage import scratch
from joulemill.streaming.run import state_partitions


def version(spark, root: str, number: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/model/{number}")


def learned(stream: DataFrame, first: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], root: str | None = None) -> tuple[str, int]:
    """Run ``step(model, batch) -> model`` over everything available; returns the folder and the number of the last version.

    Version ``b`` of the model is a table written by batch ``b`` from version ``b - 1``; ``first`` is version -1. Nothing is kept on the driver: a
    query started again with the same ``root`` goes on from the last committed batch, and a batch that runs twice starts from the same version and
    replaces its own. ``root`` also holds the stream's checkpoint."""
    spark = stream.sparkSession
    root = root or scratch(spark, "model")
    schema = first.schema
    seen = {"last": -1}
    if not _exists(spark, f"{root}/model/-1/_SUCCESS"):
        first.write.mode("overwrite").parquet(f"{root}/model/-1")

    def learn(batch: DataFrame, number: int) -> None:
        model = spark.read.schema(schema).parquet(f"{root}/model/{number - 1}")
        step(model, batch).write.mode("overwrite").parquet(f"{root}/model/{number}")

    with state_partitions(spark):
        q = stream.writeStream.foreachBatch(learn).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    while _exists(spark, f"{root}/model/{seen['last'] + 1}/_SUCCESS"):
        seen["last"] += 1
    return root, seen["last"]


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
