"""As-of, interval and skew-proof joins, built from unions, windows and equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from joulemill.operators.ordered import GROUP_ROWS, running
from joulemill.storage import checked_broadcast, cut


def _latest_match(left, right, on, by, value, tie, forward, exact, group_rows):
    """Nearest right row on one side of every left row: both sides are stacked in time order and the last
    right row seen so far is carried forward. One shuffle, no pairs."""
    # among equal times, right rows come first when they may match
    first, second = (0, 1) if exact else (1, 0)
    l = left.select("*", F.lit(None).cast(right.select(F.struct(on, *value)).schema[0].dataType).alias("_m"), F.lit(second).alias("_side"),
                    F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(True).alias("_left"))
    r = right.select(*by, on, F.struct(on, *value).alias("_m"), F.lit(first).alias("_side"), F.col(tie).alias("_tie"), F.lit(False).alias("_left"))
    stacked = l.unionByName(r, allowMissingColumns=True)
    time = F.col(on).desc() if forward else F.col(on).asc()
    tie_order = F.col("_tie").desc_nulls_last() if forward else F.col("_tie").asc_nulls_last()
    order = [time, F.col("_side"), tie_order]
    return running(stacked, by, order, {"_match": ("last", F.col("_m"))}, group_rows).filter("_left").drop("_m", "_side", "_tie", "_left")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    value: Sequence[str] = (),
    tie: str | None = None,
    direction: str = "backward",
    tolerance_s: float | None = None,
    allow_exact_matches: bool = True,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Left rows with the ``value`` columns of the nearest right row in time, and its time in ``matched_<on>``.

    ``direction`` is backward (last right row at or before), forward (first at or after) or nearest
    (ties go backward). ``tie`` orders right rows of equal time: backward takes the highest, forward the
    lowest. Matches farther than ``tolerance_s`` seconds become null.
    """
    by, value = list(by), list(value)
    tie = tie or (value[0] if value else on)
    args = (right, on, by, value, tie)

    def gap(match: Column) -> Column:
        return F.abs(F.unix_micros(F.col(on)) - F.unix_micros(match.getField(on)))

    if direction == "nearest":
        back = _latest_match(left, *args, False, allow_exact_matches, group_rows).withColumnRenamed("_match", "_back")
        out = _latest_match(back, *args, True, allow_exact_matches, group_rows)
        b, f = F.col("_back"), F.col("_match")
        closer = b.isNotNull() & (f.isNull() | (gap(b) <= gap(f)))
        out = out.withColumn("_match", F.when(closer, b).otherwise(f)).drop("_back")
    else:
        out = _latest_match(left, *args, direction == "forward", allow_exact_matches, group_rows)
    match = F.col("_match")
    if tolerance_s is not None:
        match = F.when(gap(match) <= F.lit(int(tolerance_s * 1_000_000)), match)
    picked = out.withColumn("_match", match)
    return picked.select(*[c for c in left.columns], F.col(f"_match.{on}").alias(f"matched_{on}"),
                         *[F.col(f"_match.{c}").alias(c if c not in left.columns else f"right_{c}") for c in value])


def points_in_spans(
    points: DataFrame,
    spans: DataFrame,
    at: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    base: int = 1,
) -> DataFrame:
    """Join every point with the spans [start, end] that hold it (numeric columns, equal ``keys``).

    A span of length d goes to the lowest level whose cells, base * 2^level wide, are at least d wide, so it touches at
    most two cells; the logarithm is corrected by comparing widths, since a float may fall short by one. A point looks up one cell per level in use (at most 64). The rest is an equi-join
    with a residual filter, whatever the mix of span lengths.
    """
    keys = list(keys)
    length = F.greatest(F.col(end) - F.col(start), F.lit(base))
    guess = F.greatest(F.ceil(F.log2(length / F.lit(base))).cast("int") - 1, F.lit(0))
    wide = lambda level: F.call_function("shiftleft", F.lit(base).cast("long"), level) >= length
    leveled = spans.withColumn("_guess", guess).withColumn("_level", F.when(wide(F.col("_guess")), F.col("_guess")).when(wide(F.col("_guess") + 1), F.col("_guess") + 1).otherwise(F.col("_guess") + 2)).drop("_guess")
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect())  # few by construction
    if not levels:
        levels = [0]
    width = F.lit(base) * F.pow(F.lit(2.0), F.col("_level"))
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    cells = leveled.withColumn("_cell", F.explode(F.array_distinct(F.array(first, last))))
    probes = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn(
        "_cell", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    return probes.join(cells, [*keys, "_level", "_cell"]).filter(inside).drop("_level", "_cell")


def salted_join(big: DataFrame, small: DataFrame, key: str, hot_rows: int, splits: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join in which keys with more than ``hot_rows`` rows on the big side are spread over ``splits``
    sub-keys; only the matching small rows are copied. At most rows / hot_rows keys can be hot. Joins that keep unmatched small
    rows are refused: their copies would come out once for each sub-key. Rows with a null key match nothing and are spread, too."""
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti"):
        raise ValueError(f"a salted join can't be {how}")
    hot = cut(big.groupBy(key).count().filter(F.col("count") > hot_rows).select(key, F.lit(True).alias("_hot")), "hot")
    hot = checked_broadcast(hot)
    # by row number, not by content: copies of one row must spread too. Numbered on ``big`` itself, before any
    # shuffle, so that a task run again gives its rows the same numbers
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(splits))
    left = big.withColumn("_spread", spread).join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), F.col("_spread")).otherwise(F.lit(0).cast("long"))).drop("_hot", "_spread")
    every = F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))
    right = small.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def salted_totals(df: DataFrame, keys: Sequence[str], sums: Sequence[str], splits: int = 16) -> DataFrame:
    """Two-stage count and sums: (keys, salt) first, keys after, so no reducer meets a whole hot key."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(splits)).alias("_salt")  # copies combine map-side
    first = df.groupBy(*keys, salt).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return first.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
