"""Frame-style operators: explicit order column instead of an index, nulls skipped, ``min_periods`` kept."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from joulemill.operators.exact import exact_avg
from joulemill.operators.ordered import GROUP_ROWS, framed, positions, ranks, running, with_totals


def floordiv(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def floormod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return a - F.floor(a / b) * b


def sample_skew(n: Column, g: Column) -> Column:
    """Bias-corrected skewness from the population form."""
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(n: Column, g: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, n: int, stats: dict[str, str],
            min_periods: int | None = None, q: float = 0.5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Statistics over the last ``n`` rows by position; null below ``min_periods`` non-null values (default n)."""
    if n < 0:
        raise ValueError("window must be non-negative")
    need = n if min_periods is None else min_periods
    c = F.col(value)

    def stat(kind):
        def build(w, _):
            count = F.count(c).over(w)
            forms = {
                "count": lambda: count.cast("double"), "sum": lambda: F.sum(c).over(w), "min": lambda: F.min(c).over(w), "max": lambda: F.max(c).over(w),
                "mean": lambda: F.avg(c).over(w), "std": lambda: F.stddev_samp(c).over(w), "var": lambda: F.var_samp(c).over(w),
                "quantile": lambda: F.percentile(c, F.lit(q)).over(w),
                "skew": lambda: sample_skew(count, F.skewness(c).over(w)), "kurt": lambda: sample_kurt(count, F.kurtosis(c).over(w)),
            }
            return F.when(count >= need, forms[kind]())
        return build

    return framed(df, keys, order, max(n - 1, 0), 0, {name: stat(kind) for name, kind in stats.items()}, group_rows)


def expanding(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, stats: dict[str, str],
              min_periods: int = 1, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Statistics over all rows so far, from running power sums centred on the group mean."""
    c = F.col(value)
    base = with_totals(df, keys, [exact_avg(c).alias("_mid")])
    d = c - F.col("_mid")
    out = running(base, keys, order, {
        "_n": ("count", c), "_s": ("sum", c), "_lo": ("min", c), "_hi": ("max", c),
        "_p1": ("sum", d), "_p2": ("sum", d * d), "_p3": ("sum", d * d * d), "_p4": ("sum", d * d * d * d),
    }, group_rows)
    n = F.col("_n")
    m1, m2, m3, m4 = (F.col(f"_p{i}") / n for i in (1, 2, 3, 4))
    v = m2 - m1 * m1
    c3 = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    c4 = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    var = F.when(n > 1, v * n / (n - 1))
    forms = {"count": n.cast("double"), "sum": F.col("_s"), "min": F.col("_lo"), "max": F.col("_hi"), "mean": F.col("_s") / n, "var": var, "std": F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))),
             "skew": sample_skew(n, F.try_divide(c3, F.pow(v, F.lit(1.5)))), "kurt": sample_kurt(n, F.try_divide(c4, v * v) - 3)}
    out = out.withColumns({name: F.when(n >= min_periods, forms[kind]) for name, kind in stats.items()})
    return out.drop("_mid", "_n", "_s", "_lo", "_hi", "_p1", "_p2", "_p3", "_p4")


def ewm_alpha(com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    given = [x for x in (com, span, halflife, alpha) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of com, span, halflife and alpha")
    if com is not None:
        return 1 / (1 + com)
    if span is not None:
        return 2 / (1 + span)
    if halflife is not None:
        return 1 - math.exp(-math.log(2) / halflife)
    return alpha


def ewm_mean(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, alpha: float,
             min_periods: int = 1, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Exponentially weighted mean: weights (1 - alpha)^age over the rows so far, nulls skipped but ageing.

    Rows older than ``reach`` weigh less than one unit in the last place of the result, so a row needs only
    the rows of its own block of positions and of the block before it. Each block computes its scaled sums
    by a running sum, and weights inside stay within the range of a double.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    keep = 1.0 - alpha
    c = F.col(value)
    if keep == 0.0:
        return df.withColumn(name, c)
    reach = max(1, math.ceil(math.log(1e-18) / math.log(keep)))
    placed = positions(df, keys, order, "_pos", group_rows).withColumn("_home", F.floor((F.col("_pos") - 1) / reach))
    copies = placed.withColumn("_run", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = Window.partitionBy(*keys, "_run").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # position inside the two blocks, counted from the start of the earlier one; weight grows with it
    local = F.col("_pos") - 1 - (F.col("_run") - 1) * reach
    weight = F.pow(F.lit(1.0 / keep), local - 2 * reach)
    num = F.sum(F.when(c.isNotNull(), c * weight)).over(w)
    den = F.sum(F.when(c.isNotNull(), weight)).over(w)
    out = copies.withColumn(name, num / den).filter("_run = _home")
    if min_periods > 1:
        out = running(out, keys, [F.col("_pos")], {"_seen": ("count", c)}, group_rows).withColumn(name, F.when(F.col("_seen") >= min_periods, F.col(name))).drop("_seen")
    return out.drop("_pos", "_home", "_run")


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """cumsum, cummin, cummax, cumprod and cumcount; null rows stay null. The product is sign * exp(sum(log|x|))."""
    c = F.col(value)
    out = running(df, keys, order, {
        "cumsum": ("sum", c), "cummin": ("min", c), "cummax": ("max", c), "_n": ("count", F.lit(1)),
        "_zeros": ("sum", (c == 0).cast("int")), "_minus": ("sum", (c < 0).cast("int")), "_logs": ("sum", F.log(F.abs(F.when(c != 0, c)))),
    }, group_rows)
    sign = F.when(F.col("_zeros") > 0, 0.0).when(F.col("_minus") % 2 == 1, -1.0).otherwise(1.0)
    out = out.withColumn("cumprod", sign * F.exp(F.coalesce("_logs", F.lit(0.0)))).withColumn("cumcount", F.col("_n") - 1)
    shown = {n: F.when(c.isNotNull(), F.col(n)) for n in ("cumsum", "cummin", "cummax", "cumprod")}
    return out.withColumns(shown).drop("_n", "_zeros", "_minus", "_logs")


def shifted(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, periods: int = 1, group_rows: int = GROUP_ROWS) -> DataFrame:
    """shift, diff and pct_change by ``periods`` rows (negative looks ahead)."""
    look = (lambda _, w: F.lag(value, periods).over(w)) if periods >= 0 else (lambda _, w: F.lead(value, -periods).over(w))
    out = framed(df, keys, order, max(periods, 0), max(-periods, 0), {"shift": look}, group_rows)
    c, s = F.col(value), F.col("shift")
    return out.withColumns({"diff": c - s, "pct_change": F.try_divide(c - s, s)})


def fill(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """ffill, bfill and linear interpolation by position. ``order`` lists (column, ascending)."""
    up = [F.col(c).asc() if a else F.col(c).desc() for c, a in order]
    down = [F.col(c).desc() if a else F.col(c).asc() for c, a in order]
    c = F.col(value)
    placed = positions(df, keys, up, "_pos", group_rows)
    mark = F.when(c.isNotNull(), F.struct("_pos", c.alias("v")))
    out = running(placed, keys, up, {"_back": ("last", mark)}, group_rows)
    out = running(out, keys, down, {"_ahead": ("last", mark)}, group_rows)
    b, a = F.col("_back"), F.col("_ahead")
    step = (F.col("_pos") - b["_pos"]) / (a["_pos"] - b["_pos"])
    line = F.when(c.isNotNull(), c).when(a.isNull(), b["v"]).when(b.isNotNull(), b["v"] + (a["v"] - b["v"]) * step)
    return out.withColumns({"ffill": b["v"], "bfill": a["v"], "interpolate": line}).drop("_pos", "_back", "_ahead")


def resample(df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int, closed: str = "left", label: str = "left") -> DataFrame:
    """min, max, sum, mean, std and var per time bin, with empty bins between a key's first and last filled in.

    Only aggregates are expanded: the calendar of a key comes from its first and last bin.
    """
    us = F.unix_micros(F.col(ts))
    width = seconds * 1_000_000
    cell = F.floor(us / width) if closed == "left" else F.ceil(us / width) - 1
    bins = df.groupBy(*keys, cell.alias("_bin")).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.var_samp(value).alias("var"), F.count(value).alias("n"))
    calendar = bins.groupBy(*keys).agg(F.min("_bin").alias("_a"), F.max("_bin").alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias("_bin"))
    edge = F.col("_bin") + (0 if label == "left" else 1)
    return calendar.join(bins, [*keys, "_bin"], "left").withColumn("bin", F.timestamp_seconds(edge * seconds)).withColumns(
        {"sum": F.coalesce("sum", F.lit(0.0)), "n": F.coalesce("n", F.lit(0).cast("long"))}).drop("_bin")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, tie: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pearson correlation of the average ranks, rows with a null on either side left out."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y, tie)
    rx = ranks(pairs, keys, x, tie, group_rows=group_rows).select(*keys, y, tie, F.col("avg_rank").alias("_rx"))
    both = ranks(rx, keys, y, tie, group_rows=group_rows).withColumnRenamed("avg_rank", "_ry")
    return both.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"))


def kendall(df: DataFrame, x: str, y: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Tau-b without forming pairs.

    Rows are reduced to (x, y, count) cells. Discordant pairs are the weighted inversions of y in x order: y is
    replaced by its dense place, and for every bit level the cells are grouped by the higher bits; within a
    group, a cell whose bit is 0 is inverted with every earlier cell whose bit is 1. Work is cells * log(cells).
    """
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    ys = positions(cells.select("y").distinct(), [], [F.col("y")], "_y", group_rows)
    cells = cells.join(ys, "y").withColumn("_y", F.col("_y") - 1)
    depth = max(1, int(ys.count() - 1).bit_length())
    levels = cells.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    high = F.floor(F.col("_y") / F.pow(F.lit(2), F.col("_bit") + 1)).cast("long")
    one = F.floor(F.col("_y") / F.pow(F.lit(2), F.col("_bit"))).cast("long") % 2
    levels = levels.withColumns({"_high": high, "_one": one})
    # equal x are not pairs: inside one x, zeros come first and see no ones of the same x
    seen = running(levels, ["_bit", "_high"], [F.col("x"), F.col("_one"), F.col("_y")], {"_ones": ("sum", F.when(F.col("_one") == 1, F.col("n")).otherwise(0))}, group_rows)
    swapped = seen.filter("_one = 0").agg(F.coalesce(F.sum(F.col("n") * F.coalesce("_ones", F.lit(0))), F.lit(0)).alias("_discordant"))

    def ties(*cols):
        return cells.groupBy(*cols).agg(F.sum("n").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("_".join(("_t", *cols))))

    total = cells.agg(F.sum("n").alias("_all"))
    every = total.crossJoin(swapped).crossJoin(ties("x")).crossJoin(ties("y")).crossJoin(ties("x", "y"))  # one row each
    pairs = F.col("_all") * (F.col("_all") - 1) / 2
    concordant = pairs - F.col("_t_x") - F.col("_t_y") + F.col("_t_x_y") - F.col("_discordant")
    return every.select(((concordant - F.col("_discordant")) / F.sqrt((pairs - F.col("_t_x")) * (pairs - F.col("_t_y")))).alias("kendall"))
