"""How many executors to allow at a given carbon intensity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from joulemill.operators.ordered import framed

LOWER_MARGIN = 1.1  # the lower forecast bound is raised a little to react sooner
HORIZON = 48  # trace rows looked ahead for the bounds
CPU_PER_EXECUTOR, MEMORY_GI_PER_EXECUTOR = 4, 8


def lambert_w(x: Column) -> Column:
    """Principal branch for x >= -1/e by a fixed number of Halley steps, all inside one expression."""
    start = F.when(x < 0, F.sqrt(F.greatest((x * math.e + 1) * 2, F.lit(0.0))) - 1).otherwise(x / (x + 1))

    def step(w: Column, _: Column) -> Column:
        f = w * F.exp(w) - x
        slope = F.exp(w) * (w + 1) - (w + 2) * f / (w * 2 + 2)
        return F.when(F.abs(f) < 1e-15, w).otherwise(w - f / slope)

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step)


def allowed_executors(c: Column, lower: Column, upper: Column, floor: Column, drivers: Column, cap: Column) -> Column:
    """Executors allowed at intensity ``c`` given forecast bounds; ``cap`` when no threshold lies below c.

    With k = cap - floor - drivers controllable executors, threshold i prices the i-th of them. The answer is
    floor + (index of the first threshold below c, from 0). Thresholds rise when the raised lower bound
    exceeds the upper one, so the first index is searched instead of counting.
    """
    k = cap - floor - drivers
    low = lower * LOWER_MARGIN
    alpha = F.lit(1.0) / (F.lit(1.0) + lambert_w((low / upper - 1) / math.e))

    def search(a: Column) -> Column:
        growth = F.lit(1.0) + F.lit(1.0) / (a * k)
        steps = F.filter(
            F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1),
            lambda i: upper * (F.lit(1.0) - (F.lit(1.0) - F.lit(1.0) / a) * F.pow(growth, i)) < c,
        )
        return F.coalesce(floor + F.get(steps, F.lit(0)), cap)

    # As the element of an array the root is computed once for a row, and not again for every threshold.
    found = F.get(F.transform(F.array(alpha), search), F.lit(0))
    return F.when((k <= 0) | (upper <= 0), cap).otherwise(found).cast("long")


def resource_limits(df: DataFrame, executors: str = "allowed") -> DataFrame:
    return df.withColumns({
        "cpu": F.col(executors) * CPU_PER_EXECUTOR,
        "memory_gi": F.col(executors) * MEMORY_GI_PER_EXECUTOR,
    })


def forecast_bounds(trace: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Lowest and highest intensity over the next ``horizon`` rows of the trace."""
    return framed(trace, [], [F.col("idx")], 0, horizon - 1, {
        "lower_bound": lambda w, _: F.min("ci").over(w),
        "upper_bound": lambda w, _: F.max("ci").over(w),
    })


def live_pods(listing: DataFrame, line: str = "line") -> DataFrame:
    """Driver pods that still run and executor pods in Running state, per snapshot."""
    text = F.col(line)
    driver = text.contains("-driver") & ~text.contains("Completed") & ~text.contains("Error")
    executor = text.contains("-exec-") & text.contains("Running")
    return listing.groupBy("snapshot").agg(
        F.count_if(driver).alias("drivers"), F.count_if(executor).alias("executors")
    )
