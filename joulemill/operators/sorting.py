"""Sort, limit, offset and top-k."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from joulemill.operators.ordered import positions
from joulemill.registry import query

RANKED = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders"


@query("srt_01_sort", "SRT-01", RANKED)
def sort(t):
    """Global sort with its place: the number comes from a range-partitioned sort, not one task."""
    return positions(t.orders.select("o_orderkey", "o_totalprice"), [], [F.desc("o_totalprice"), F.asc("o_orderkey")], "place").sort("place")


@query("srt_02_sort_within_partitions", "SRT-02", "SELECT count(*) AS n, true AS sorted FROM orders")
def sort_within_partitions(t):
    """Local sort only; every partition is then checked to be in order, batch by batch."""
    def check(batches):
        last, good, n = None, True, 0
        for pdf in batches:
            keys = list(zip(pdf["o_custkey"], pdf["o_orderkey"]))
            if keys:
                good = good and keys == sorted(keys) and (last is None or last <= keys[0])
                last, n = keys[-1], n + len(keys)
        if n:
            yield pd.DataFrame({"n": [n], "good": [good]})

    local = t.orders.select("o_custkey", "o_orderkey").repartition(8, "o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")
    return local.mapInPandas(check, "n long, good boolean").agg(F.sum("n").alias("n"), F.bool_and("good").alias("sorted"))


@query("srt_03_limit", "SRT-03 SRT-05 SRT-06 SRT-07", f"SELECT * FROM ({RANKED}) WHERE place <= 20")
def limit(t):
    """Top-k is planned as TakeOrderedAndProject: k rows per task, merged once. take/head/first agree with it."""
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    top = t.orders.select("o_orderkey", "o_totalprice").orderBy(*order)
    first = top.first()["o_orderkey"]
    assert [r["o_orderkey"] for r in top.take(3)] == [r["o_orderkey"] for r in top.head(3)] and top.head()["o_orderkey"] == first
    return positions(top.limit(20), [], order, "place")


@query("srt_04_offset", "SRT-04", f"SELECT * FROM ({RANKED}) WHERE place > 20 AND place <= 45")
def offset(t):
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    page = t.orders.select("o_orderkey", "o_totalprice").orderBy(*order).offset(20).limit(25)
    return positions(page, [], order, "p").select("o_orderkey", "o_totalprice", (F.col("p") + 20).alias("place"))


@query("srt_f_null_order", "SRT-F", """
WITH c AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer),
d AS (SELECT c_nationkey, max(b) AS b FROM c GROUP BY 1 UNION ALL SELECT 99, NULL)
SELECT c_nationkey, row_number() OVER (ORDER BY b ASC NULLS FIRST, c_nationkey) AS a_first, row_number() OVER (ORDER BY b ASC NULLS LAST, c_nationkey) AS a_last,
 row_number() OVER (ORDER BY b DESC NULLS FIRST, c_nationkey) AS d_first, row_number() OVER (ORDER BY b DESC NULLS LAST, c_nationkey) AS d_last FROM d""")
def null_order(t):
    """Sort-order expressions over one row per nation (with one null balance injected)."""
    c = t.customer.withColumn("b", F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_acctbal")))
    d = c.groupBy("c_nationkey").agg(F.max("b").alias("b"))
    extra = c.agg(F.lit(99).alias("c_nationkey"), F.lit(None).cast("double").alias("b"))
    d = d.union(extra)
    for name, by in (("a_first", F.asc_nulls_first("b")), ("a_last", F.asc_nulls_last("b")),
                     ("d_first", F.desc_nulls_first("b")), ("d_last", F.desc_nulls_last("b"))):
        d = positions(d, [], [by, F.asc("c_nationkey")], name)
    return d.drop("b")
