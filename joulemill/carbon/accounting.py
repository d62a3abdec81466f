"""Carbon intensity over time and its attribution to jobs.

A trace is an hourly series. One real minute counts as one trace hour, and a run that outlives the trace
starts again at its first row, so the row for a moment is ``(offset + elapsed minutes) mod rows``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from joulemill.operators.exact import exact_avg, exact_sum
from joulemill.operators.ordered import positions
from joulemill.storage import checked_broadcast, cut

START_ROW = 5  # trace row at which the study starts


@dataclass(frozen=True)
class Trace:
    rows: DataFrame  # hour, ci, idx (0-based)
    size: int
    origin_us: int  # first sample time, in epoch microseconds


def hourly_trace(events: DataFrame) -> Trace:
    """Hourly mean of ``events.value``: one partial aggregation over the scan, then a table of at most
    one row per hour that is written once and reused."""
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        exact_avg("value").alias("ci"), F.min(F.unix_micros("ts")).alias("first_us")
    )
    hours = cut(hours, "trace")
    size, origin = hours.agg(F.count("*"), F.min("first_us")).first()
    numbered = positions(hours, [], [F.col("hour")], "_n").select("hour", "ci", (F.col("_n") - 1).alias("idx"))
    return Trace(numbered, size, origin)


def samples(events: DataFrame) -> DataFrame:
    """Executor samples: the user is the job, the event type the model, the week the run."""
    return events.select(
        F.col("user_id").alias("job_id"),
        F.col("event_type").alias("model"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("tag"),
        "ts",
        "event_id",
        F.pmod("event_id", F.lit(4)).alias("pod"),
    )


def price(sampled: DataFrame, trace: Trace, offset: int = START_ROW) -> DataFrame:
    """Attach the intensity in force at every sample (equi-join on the trace row number)."""
    minutes = F.floor((F.unix_micros("ts") - F.lit(trace.origin_us)) / F.lit(60_000_000))
    at = sampled.withColumn("idx", F.pmod(minutes + F.lit(offset), F.lit(trace.size)).cast("long"))
    return at.join(checked_broadcast(trace.rows.select("idx", "ci")), "idx")


def job_runs(priced: DataFrame) -> DataFrame:
    """One row per (model, run, job): each sample adds intensity / 60. A job seen once has not finished."""
    return priced.groupBy("model", "tag", "job_id").agg(
        F.min("ts").alias("start_time"),
        F.when(F.count("*") > 1, F.max("ts")).alias("end_time"),
        (exact_sum("ci") / 60).alias("carbon_footprint"),
        F.count("*").alias("samples"),
    )


def runs_of(events: DataFrame) -> DataFrame:
    return job_runs(price(samples(events), hourly_trace(events)))


def attribute(sampled: DataFrame, drivers: DataFrame, on: str = "driver") -> tuple[DataFrame, DataFrame]:
    """Samples of known driver pods with their job, and the samples no driver owns."""
    return sampled.join(drivers, on), sampled.join(drivers, on, "left_anti")


def keep_measured(runs: DataFrame) -> DataFrame:
    """Drop failed jobs: non-zero return code or a footprint below 1."""
    return runs.filter((F.col("return_code") == 0) & (F.col("carbon_footprint") >= 1))
