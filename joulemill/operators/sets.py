"""Set operations over key columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulemill.registry import query


def _keys(t):
    buyers = t.orders.select((F.col("o_custkey") % 97).alias("k"))
    lines = t.lineitem.filter("l_quantity > 45").select((F.col("l_partkey") % 131).alias("k"))
    return buyers, lines


BUYERS = "SELECT o_custkey % 97 AS k FROM orders"
LINES = "SELECT l_partkey % 131 AS k FROM lineitem WHERE l_quantity > 45"


@query("set_01_union", "SET-01", f"SELECT k, count(*) AS n FROM ({BUYERS} UNION ALL {LINES}) GROUP BY 1")
def union(t):
    a, b = _keys(t)
    return a.union(b).groupBy("k").agg(F.count("*").alias("n"))


@query("set_02_union_by_name", "SET-02", """
SELECT s_suppkey AS id, s_nationkey AS nation, -1 AS segment_length FROM supplier
UNION ALL SELECT c_custkey, c_nationkey, length(c_mktsegment) FROM customer""")
def union_by_name(t):
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.length("c_mktsegment").alias("segment_length"))
    return s.unionByName(c, allowMissingColumns=True).fillna(-1, ["segment_length"])


@query("set_03_intersect", "SET-03", f"{BUYERS} INTERSECT {LINES}")
def intersect(t):
    a, b = _keys(t)
    return a.intersect(b)


@query("set_04_intersect_all", "SET-04", f"{BUYERS} INTERSECT ALL {LINES}")
def intersect_all(t):
    a, b = _keys(t)
    return a.intersectAll(b)


@query("set_05_subtract", "SET-05", f"{LINES} EXCEPT {BUYERS}")
def subtract(t):
    a, b = _keys(t)
    return b.subtract(a)


@query("set_06_except_all", "SET-06", f"{BUYERS} EXCEPT ALL {LINES}")
def except_all(t):
    a, b = _keys(t)
    return a.exceptAll(b)
