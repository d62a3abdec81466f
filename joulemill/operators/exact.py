"""Sums of doubles that are the same in any order of the rows, so also at any number of partitions.

Every value is cut into four integers on a fixed grid, with weights 2**40, 1, 2**-40 and 2**-80; cuts and remainders are exact in a double.
Integers add up exactly in any order, and the only rounding is the one at the end. Places below 2**-80 (8e-25) are cut off each value. Values from
2**100 on, infinities and NaN go into a plain sum beside them, which is order-independent for the latter two.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

STEP = 40
WEIGHT = float(1 << STEP)
MOST = float(1 << 100)


def parts(x: Column) -> list[Column]:
    """Four integers (decimals) and a double for what has none; their sums are the arguments of ``joined``.

    Scaling by a power of two, the remainder and the cast towards zero are all exact, so each integer comes straight from the value."""
    x = x.cast("double")
    inside = F.abs(x) < MOST  # NaN compares as the largest number
    value = F.when(inside, x).when(x.isNotNull(), F.lit(0.0))
    top = (value / WEIGHT).cast("long").cast("decimal(19,0)")
    rest = [(value * WEIGHT**i % WEIGHT).cast("long").cast("decimal(13,0)") for i in range(3)]
    return [top, *rest, F.when(~inside, x)]


def joined(sums: list[Column]) -> Column:
    """The double nearest to the exact total, but for the last place."""
    top, units, low, lowest = (s.cast("decimal(25,0)") for s in sums[:4])
    step, two = F.lit(Decimal(1 << STEP)), F.lit(Decimal(1 << 2 * STEP))
    whole, below = top * step + units, low * step + lowest
    carry = F.floor(below.cast("double") / float(1 << 2 * STEP)).cast("decimal(13,0)")
    total = (whole + carry).cast("double") + (below - carry * two).cast("double") / float(1 << 2 * STEP)
    return total + F.coalesce(sums[4], F.lit(0.0))


def piece_sums(x: np.ndarray) -> list[int | float]:
    """Sums over an array of what ``parts`` makes of each value: what a task hands on where it has many rows for few totals."""
    inside = np.abs(x) < MOST
    value, low = np.where(inside, x, 0.0), (1 << 30) - 1
    whole = [(value / WEIGHT).astype(np.int64), *[np.fmod(value * WEIGHT**i, WEIGHT).astype(np.int64) for i in range(3)]]
    return [*[(int((w >> 30).sum()) << 30) + int((w & low).sum()) for w in whole], float(x[~inside].sum())]


def exact_sum(x: Column | str) -> Column:
    """Aggregate: the order-independent sum; null if all are."""
    return joined([F.sum(p) for p in parts(F.col(x) if isinstance(x, str) else x)])


def exact_avg(x: Column | str) -> Column:
    """Aggregate: the order-independent mean; null if all are."""
    x = F.col(x) if isinstance(x, str) else x
    return exact_sum(x) / F.count(x)


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded half up as a decimal of nine places, so that a total on the edge between two results doesn't depend on its last binary place."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("decimal(38,9)"), digits).cast("double")


def is_floating(df: DataFrame, x: Column) -> bool:
    return df.select(x.alias("x")).schema["x"].dataType.typeName() in ("double", "float")
