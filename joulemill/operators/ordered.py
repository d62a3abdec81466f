"""Order-sensitive operators that stay bounded per task however hot a key is.

A plain window sorts a whole key in one task. Every function here first measures the largest group; up to
``GROUP_ROWS`` it uses the plain window, beyond it the rows are range-partitioned on (keys, order), written
once, worked on per (chunk, key), and finished with the carried totals of the earlier chunks. Both ways
give the same rows. ``order`` must be a total order within a key for repeatable results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from joulemill.operators.exact import is_floating, joined, parts
from joulemill.storage import cut

GROUP_ROWS = 2_000_000


def hottest(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest key group (map-side combined, one number to the driver)."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a per-key summary (unique on keys, null keys match); AQE splits hot keys of ``df``."""
    if not keys:
        return df.crossJoin(F.broadcast(summary))  # a global aggregate: exactly one row
    renamed = summary.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in summary.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(renamed, on, "left").drop(*[f"_k_{k}" for k in keys])


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int) -> DataFrame:
    """Range-partition on (keys, order) into chunks of about ``rows`` rows, numbered in ``_chunk``.

    The result is written before use, so the sampled bounds cannot differ between two reads of it.
    """
    parts = max(2, math.ceil(df.count() / max(1, rows)))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut(ranged.withColumn("_chunk", F.spark_partition_id()), "chunks")


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Exact 1-based row number per key (or over the whole table when ``keys`` is empty)."""
    if hottest(df, keys) <= group_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    ranged = chunks(df, keys, order, group_rows)
    groups = ["_chunk", *keys]
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*groups).agg(F.count("*").alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return attach(ranged.withColumn("_local", local), offsets, groups).withColumn(
        name, (F.col("_local") + F.col("_off")).cast("long")
    ).drop("_local", "_off", "_chunk")


# name -> (running form within a chunk, total of a chunk, carry over earlier totals, merge of carry and local)
def _last(c):
    return F.last(c, ignorenulls=True)


def _first(c):
    return F.first(c, ignorenulls=True)


_RUNNING: dict[str, tuple] = {
    "sum": (F.sum, F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, F.min, F.min, F.least),
    "max": (F.max, F.max, F.max, F.greatest),
    "last": (_last, None, _last, lambda a, b: F.coalesce(b, a)),
    "first": (_first, None, _first, lambda a, b: F.coalesce(a, b)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    aggs: dict[str, tuple[str, Column]],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add running aggregates over (unbounded preceding .. current row).

    ``aggs`` maps an output name to (function, column); functions are sum, count, min, max, last and first
    (last/first skip nulls, so ``last`` is a forward fill). Sums of doubles are exact until the end, so both ways agree to the last bit.
    """
    doubles = [n for n, (f, c) in aggs.items() if f == "sum" and is_floating(df, c)]
    if doubles:
        whole = {n: a for n, a in aggs.items() if n not in doubles}
        pieces = {n: [f"_{i}_{n}" for i in range(5)] for n in doubles}
        for n in doubles:
            whole |= {name: ("sum", p) for name, p in zip(pieces[n], parts(aggs[n][1]))}
        out = _running(df, keys, order, whole, group_rows)
        return out.withColumns({n: joined([F.col(p) for p in pieces[n]]) for n in doubles}).drop(*[p for n in doubles for p in pieces[n]])
    return _running(df, keys, order, aggs, group_rows)


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], aggs: dict[str, tuple[str, Column]], group_rows: int) -> DataFrame:
    to_here = (Window.unboundedPreceding, Window.currentRow)
    if hottest(df, keys) <= group_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*to_here)
        return df.withColumns({n: _RUNNING[f][0](c).over(w) for n, (f, c) in aggs.items()})
    groups = ["_chunk", *keys]
    w = Window.partitionBy(*groups).orderBy(*order)
    ranged = chunks(
        df.withColumns({f"_in_{n}": c for n, (_, c) in aggs.items()}), keys, order, group_rows
    ).withColumn("_at", F.row_number().over(w))
    totals = []
    for n, (f, _) in aggs.items():
        value = F.col(f"_in_{n}")
        if f in ("last", "first"):
            pick = F.max_by if f == "last" else F.min_by
            totals.append(pick(value, F.when(value.isNotNull(), F.col("_at"))).alias(f"_tot_{n}"))
        else:
            totals.append(_RUNNING[f][1](value).alias(f"_tot_{n}"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy(*groups).agg(*totals).select(
        *groups, *[_RUNNING[f][2](F.col(f"_tot_{n}")).over(earlier).alias(f"_carry_{n}") for n, (f, _) in aggs.items()]
    )
    local = ranged.withColumns(
        {f"_loc_{n}": _RUNNING[f][0](F.col(f"_in_{n}")).over(w.rowsBetween(*to_here)) for n, (f, _) in aggs.items()}
    )
    out = attach(local, carry, groups)
    out = out.withColumns({n: _RUNNING[f][3](F.col(f"_carry_{n}"), F.col(f"_loc_{n}")) for n, (f, _) in aggs.items()})
    helper = [f"{p}{n}" for n in aggs for p in ("_in_", "_loc_", "_carry_")]
    return out.drop("_chunk", "_at", *helper)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    before: int,
    after: int,
    exprs: dict[str, Callable],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add columns computed over the rows from ``before`` rows back to ``after`` rows ahead.

    Each expression is called with (framed window, ordered window); lag and lead take the second and may
    reach ``before`` / ``after`` rows. A hot key is cut into runs of positions, each with copies of the
    neighbouring rows its frames reach, so no task sees more than one run.
    """
    if hottest(df, keys) <= group_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: f(w.rowsBetween(-before, after), w) for n, f in exprs.items()})
    width = max(before, after, group_rows)
    placed = positions(df, keys, order, "_pos", group_rows)
    at = F.pmod(F.col("_pos") - 1, F.lit(width))
    home = F.floor((F.col("_pos") - 1) / width)
    runs = F.array_compact(F.array(
        F.col("_home"),
        F.when(at >= width - before, F.col("_home") + 1),
        F.when((at < after) & (F.col("_home") > 0), F.col("_home") - 1),
    ))
    copies = placed.withColumn("_home", home).withColumn("_run", F.explode(runs))
    w = Window.partitionBy(*keys, "_run").orderBy("_pos")
    out = copies.withColumns({n: f(w.rowsBetween(-before, after), w) for n, f in exprs.items()})
    return out.filter("_run = _home").drop("_pos", "_home", "_run")


def with_totals(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Whole-group aggregates on every row: partial aggregation, then a join on the unique keys."""
    return attach(df, df.groupBy(*keys).agg(*aggs), keys)


def ranks(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie: str,
    tiles: int = 4,
    descending: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """row_number, rank, dense_rank, percent_rank, cume_dist, ntile and average rank of ``by`` per key.

    ``tie`` makes the order total. Beyond the bound the ranks come from exact positions: rank is the lowest
    position among equal values, dense_rank the position among distinct values.
    """
    direction = F.col(by).desc() if descending else F.col(by).asc()
    if hottest(df, keys) <= group_rows:
        total = Window.partitionBy(*keys).orderBy(direction, F.col(tie))
        w = Window.partitionBy(*keys).orderBy(direction)
        ties = Window.partitionBy(*keys, by)
        return df.withColumns({
            "row_number": F.row_number().over(total).cast("long"),
            "rank": F.rank().over(w).cast("long"),
            "dense_rank": F.dense_rank().over(w).cast("long"),
            "percent_rank": F.percent_rank().over(w),
            "cume_dist": F.cume_dist().over(w),
            "ntile": F.ntile(tiles).over(total).cast("long"),
        }).withColumn("avg_rank", F.col("rank") + (F.count("*").over(ties) - 1) / 2.0)
    numbered = positions(df, keys, [direction, F.col(tie)], "row_number", group_rows)
    values = numbered.groupBy(*keys, by).agg(F.min("row_number").alias("rank"), F.max("row_number").alias("_hi"))
    values = positions(values, keys, [direction], "dense_rank", group_rows)
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = attach(attach(numbered, values, [*keys, by]), sizes, keys)
    n, row = F.col("_n"), F.col("row_number")
    base, extra = F.floor(n / tiles), F.pmod(n, F.lit(tiles))
    wide = extra * (base + 1)
    tile = F.when(row <= wide, F.ceil(row / (base + 1))).otherwise(extra + F.ceil((row - wide) / F.greatest(base, F.lit(1))))
    return out.withColumns({
        "percent_rank": F.when(n > 1, (F.col("rank") - 1) / (n - 1)).otherwise(F.lit(0.0)),
        "cume_dist": F.col("_hi") / n,
        "ntile": tile.cast("long"),
        "avg_rank": (F.col("rank") + F.col("_hi")) / 2.0,
    }).drop("_hi", "_n")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """Top-k report per key. The rank filter lets Spark keep only k rows per key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], latest: bool = False) -> DataFrame:
    """Keep the first (or last) row of every key by an aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Exact linear-interpolated percentiles per key, from value counts and their running total.

    The built-in exact aggregate keeps every distinct value of a group in one task; here the distinct
    values stay distributed and only the few rows around each wanted rank are kept.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts = cut(counts, "values")  # read three times below
    placed = running(counts, keys, [F.col(value)], {"_hi": ("sum", F.col("_n"))}, group_rows)
    placed = with_totals(placed, keys, [F.max("_hi").alias("_total")])
    low = F.col("_hi") - F.col("_n")  # ranks low .. _hi-1, counted from 0
    aggs = []
    for name, p in points.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((low <= lo) & (lo < F.col("_hi")), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((low <= hi) & (hi < F.col("_hi")), F.col(value))).alias(f"_up_{name}"),
            F.max(at - lo).alias(f"_w_{name}"),
        ]
    out = placed.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_up_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in points
    ])
