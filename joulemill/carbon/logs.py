"""Run logs: reading, cleaning, the executor-sample text and its restored times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from joulemill.operators.ordered import top_per_key

RUN_LOG = "job_id int, start_time timestamp, end_time timestamp, carbon_footprint double, executors string"
# .../{model}/{job}_{count}[_{trace}[_{suffix}]]/times_{tag}.csv, a file or a folder of part files
RUN_PATH = r"/([^/]+)/([^/_]+)_(\d+)(?:_([^/_]+))?(?:_([^/]+))?/times_([^/]+)\.csv(?:/[^/]*)?$"
# one ('mm:ss', 'pod') pair inside the executors text
SAMPLE_PAIR = r"\('(\d+:\d+)', '([^']+)'\)"


def read_run_logs(spark: SparkSession, root: str) -> DataFrame:
    """All run logs below ``root`` with their run keys taken from the path."""
    path = F.col("_metadata.file_path")
    keys = ("model", "job_type", "jobs", "trace", "suffix", "tag")
    df = spark.read.schema(RUN_LOG).option("header", True).csv(f"{root}/*/*/times_*.csv")
    return df.select("*", *[F.regexp_extract(path, RUN_PATH, i + 1).alias(k) for i, k in enumerate(keys)]).withColumn(
        "jobs", F.col("jobs").cast("int")
    )


def finished(runs: DataFrame) -> DataFrame:
    """Jobs with every field present."""
    return runs.dropna()


def first_jobs(runs: DataFrame, n: int, run: tuple[str, ...] = ("model", "tag")) -> DataFrame:
    """The first ``n`` jobs of each run by job id (the report's definition of a run)."""
    return top_per_key(runs, list(run), [F.col("job_id")], n, "_nth").drop("_nth")


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def with_duration(runs: DataFrame) -> DataFrame:
    """Duration as an interval and in seconds."""
    return runs.withColumns({
        "duration": F.col("end_time") - F.col("start_time"),
        "duration_s": seconds(F.col("end_time"), F.col("start_time")),
    })


def explode_samples(runs: DataFrame, cell: str = "executors") -> DataFrame:
    """One row per (mm:ss, pod) pair of the executors text."""
    at = F.regexp_extract_all(F.col(cell), F.lit(SAMPLE_PAIR), F.lit(1))
    pod = F.regexp_extract_all(F.col(cell), F.lit(SAMPLE_PAIR), F.lit(2))
    return runs.withColumn("_s", F.explode(F.arrays_zip(at.alias("at"), pod.alias("pod")))).select(
        *[c for c in runs.columns if c != cell], F.col("_s.at").alias("at"), F.col("_s.pod").alias("pod")
    )


def restore_sample_time(samples: DataFrame, at: str = "at", start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Full sample time from mm:ss and the job start; flags samples that fall after the job's end."""
    offset = F.split_part(at, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(at, F.lit(":"), F.lit(2)).cast("int")
    base = F.unix_seconds(F.date_trunc("hour", start)) + offset
    rolled = F.when(base < F.unix_seconds(F.date_trunc("second", start)), base + 3600).otherwise(base)
    return samples.withColumn("sample_time", F.timestamp_seconds(rolled)).withColumn(
        "outside", F.col("sample_time") > F.date_trunc("second", end)
    )
