"""Lazy access to the input tables of one scale folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Runtime settings the plans rely on: instants are read in UTC, and a skewed join is split even when a later
# aggregate on the same key then needs one more exchange.
SESSION = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}


class Tables:
    """``t.orders`` reads ``<folder>/orders.parquet``; nothing is cached, so scans stay prunable.

    Timestamps in the files carry no zone. ``events.ts`` is cast to an instant (UTC) because watermarks
    and time windows need one; the other tables keep the stored type so date filters reach the scan.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")
        for key, value in SESSION.items():
            if spark.conf.get(key, None) != value:
                spark.conf.set(key, value)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        df = self.raw(name)
        if name == "events":
            df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        return df

    def views(self, *names: str) -> SparkSession:
        """Register the named tables as session views and return the session for ``.sql``."""
        for name in names or NAMES:
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark
