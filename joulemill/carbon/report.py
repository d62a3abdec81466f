"""Run-level report metrics over (model, tag, job) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joulemill.carbon.logs import finished, seconds
from joulemill.operators.exact import exact_avg, exact_sum
from joulemill.operators.ordered import with_totals

# (model, baseline) pairs of the comparison, over event types standing in for models
CARBON_PAIRS = [("click", "view"), ("purchase", "view"), ("purchase", "signup")]
TIME_PAIRS = [("click", "view"), ("purchase", "signup")]


def run_totals(runs: DataFrame) -> DataFrame:
    return finished(runs).groupBy("model", "tag").agg(exact_sum("carbon_footprint").alias("total_carbon"))


def end_to_end(runs: DataFrame) -> DataFrame:
    """Per run: end of the last submitted job minus start of the first one, and the true makespan beside it."""
    return finished(runs).groupBy("model", "tag").agg(
        F.max_by("end_time", "job_id").alias("last_end"),
        F.min_by("start_time", "job_id").alias("first_start"),
        F.max("end_time").alias("latest_end"),
        F.min("start_time").alias("earliest_start"),
    ).select(
        "model", "tag",
        seconds(F.col("last_end"), F.col("first_start")).alias("end_to_end_s"),
        seconds(F.col("latest_end"), F.col("earliest_start")).alias("makespan_s"),
    )


def per_model(runs_metric: DataFrame, metric: str, tags: list[str] | None = None) -> DataFrame:
    """Mean over runs of a run-level metric (a mean of sums, not a pooled mean)."""
    if tags is not None:
        runs_metric = runs_metric.filter(F.col("tag").isin(tags))
    return runs_metric.groupBy("model").agg(exact_avg(metric).alias(metric))


def normalized(models: DataFrame, metric: str) -> DataFrame:
    """Metric as a share of the largest model's."""
    return with_totals(models, [], [F.max(metric).alias("_max")]).withColumn(
        f"{metric}_share", F.col(metric) / F.col("_max")
    ).drop("_max")


def against_baseline(models: DataFrame, metric: str, pairs: list[tuple[str, str]], saving: bool) -> DataFrame:
    """Percent saved (or, for times, added) against the named baseline of each pair."""
    named = models.sparkSession.createDataFrame(pairs, "model string, baseline string")
    base = models.select(F.col("model").alias("baseline"), F.col(metric).alias("_base"))
    change = (F.col("_base") - F.col(metric)) if saving else (F.col(metric) - F.col("_base"))
    return models.join(F.broadcast(named), "model").join(base, "baseline").select(
        "model", "baseline", (change / F.col("_base") * 100).alias("percent")
    )


def job_means(runs: DataFrame) -> DataFrame:
    """Mean carbon and completion time per job in each run, then averaged over runs."""
    per_run = finished(runs).groupBy("model", "tag").agg(
        exact_avg("carbon_footprint").alias("job_carbon"),
        exact_avg(seconds(F.col("end_time"), F.col("start_time"))).alias("job_seconds"),
    )
    return per_run.groupBy("model").agg(exact_avg("job_carbon").alias("job_carbon"), exact_avg("job_seconds").alias("job_seconds"))
