"""Window functions: frames, ranks and offsets. Row-level windows go through the size-checked helpers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from joulemill.operators.ordered import framed, ranks, running, with_totals
from joulemill.registry import query


@query("wnm_01_running_frames", "WNM-01 WNM-02 WNM-03 WNM-04 WNM-06 WNM-07 WNM-08", """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(sum(v) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS so_far,
 round(avg(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS centred,
 round(sum(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS remaining,
 round(v / sum(v) OVER (PARTITION BY user_id), 6) AS share FROM d""")
def running_frames(t):
    """Daily totals first, so a partition holds at most one row per calendar day and a plain window is safe."""
    d = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("day")
    chained = Window.orderBy("day").partitionBy("user_id").rowsBetween(-2, 2)
    return d.select(
        "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.round(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 4).alias("so_far"),
        F.round(F.avg("v").over(chained), 4).alias("centred"),
        F.round(F.sum("v").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)), 4).alias("remaining"),
        F.round(F.col("v") / F.sum("v").over(Window.partitionBy("user_id")), 6).alias("share"))


@query("wnm_05_range_frames", "WNM-05 WNM-09", """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(sum(v) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 4) AS week,
 count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS earlier FROM d""")
def range_frames(t):
    d = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v"))
    d = d.withColumn("n", F.unix_date(F.to_date("day")))
    w = Window.partitionBy("user_id").orderBy("n")
    return d.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.sum("v").over(w.rangeBetween(-6, 0)), 4).alias("week"),
                    F.count("*").over(Window.rangeBetween(-6, -1).partitionBy("user_id").orderBy("n")).alias("earlier"))


@query("wnm_04_running_rows", "WNM-04", """
SELECT event_id, round(sum(value) OVER w, 4) AS total, count(*) OVER w AS n, max(value) OVER w AS peak FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_rows(t):
    """Running aggregates over raw rows of a user, whatever their number."""
    out = running(t.events, ["user_id"], [F.col("ts"), F.col("event_id")],
                  {"total": ("sum", F.col("value")), "n": ("count", F.lit(1)), "peak": ("max", F.col("value"))})
    return out.select("event_id", F.round("total", 4).alias("total"), "n", "peak")


@query("win_1_ranking", "WIN-1", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
 round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS ntile
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranking(t):
    out = ranks(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    return out.select("o_orderkey", "row_number", "rank", "dense_rank", F.round("percent_rank", 6).alias("percent_rank"), F.round("cume_dist", 6).alias("cume_dist"), "ntile")


@query("win_2_offsets", "WIN-2", """
SELECT event_id, coalesce(lag(value) OVER w, -1) AS prev, coalesce(lead(value, 2) OVER w, -1) AS next2,
 coalesce(nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), -1) AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def offsets(t):
    out = framed(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], 3, 3, {
        "prev": lambda _, w: F.lag("value", 1, -1.0).over(w),
        "next2": lambda _, w: F.lead("value", 2, -1.0).over(w),
        "second": lambda w, _: F.nth_value("value", 2).over(w),
    })
    return out.select("event_id", "prev", "next2", F.coalesce("second", F.lit(-1.0)).alias("second"))


@query("wnm_02_share_of_group", "WNM-02", """
SELECT l_orderkey, l_linenumber, l_suppkey, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_suppkey), 10) AS share FROM lineitem""")
def share_of_group(t):
    """Whole-partition aggregate at line level: aggregate, then join on the supplier."""
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    out = with_totals(l, ["l_suppkey"], [F.sum("l_extendedprice").alias("_s")])
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", F.round(F.col("l_extendedprice") / F.col("_s"), 10).alias("share"))
