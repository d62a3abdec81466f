"""Partition layout and side effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulemill.registry import query
from joulemill.storage import bucket_number, gathered, scratch


@query("lay_01_repartition", "LAY-01 LAY-02 LAY-03 RD-09", """
SELECT 'hash' AS layout, 6 AS parts, count(*) AS n FROM orders UNION ALL SELECT 'round', 5, count(*) FROM orders
UNION ALL SELECT 'range', 4, count(*) FROM orders UNION ALL SELECT 'merged', 2, count(*) FROM orders""")
def repartition(t):
    """Partition counts are fixed by the call; AQE leaves numbered repartitions alone."""
    o = t.orders.select("o_orderkey", "o_custkey")
    layouts = {"hash": o.repartition(6, "o_custkey"), "round": o.repartition(5),
               "range": o.repartitionByRange(4, "o_orderkey"), "merged": o.repartition(8).coalesce(2)}
    out = None
    for name, df in layouts.items():
        part = df.withColumn("p", F.spark_partition_id()).agg(
            F.lit(name).alias("layout"), F.count_distinct("p").cast("int").alias("parts"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("lay_04_foreach", "LAY-04 LAY-05 RD-10", "SELECT count(*) AS rows_seen, count(*) AS rows_in_partitions, sum(s_nationkey)::BIGINT AS nation_sum FROM supplier")
def foreach(t):
    """Side effects on the executors, reported back through accumulators."""
    sc = t.spark.sparkContext
    seen, nations, in_parts = sc.accumulator(0), sc.accumulator(0), sc.accumulator(0)

    def one(row):
        seen.add(1)
        nations.add(row["s_nationkey"])

    def many(rows):
        in_parts.add(sum(1 for _ in rows))

    s = t.supplier.select("s_nationkey")
    s.foreach(one)
    s.foreachPartition(many)
    return t.supplier.groupBy().agg(F.count("*")).select(F.lit(seen.value).cast("long").alias("rows_seen"), F.lit(in_parts.value).cast("long").alias("rows_in_partitions"),
                                      F.lit(nations.value).cast("long").alias("nation_sum"))


@query("lay_t_partition_transforms", "LAY-T SRC-20 SRC-21", """
SELECT 'year' AS layout, year(o_orderdate) AS part, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY ALL
UNION ALL SELECT 'bucket', o_custkey % 2, count(*) FROM orders GROUP BY ALL""")
def partition_transforms(t):
    """Orders stored by year (derived column, pruned on read) and by a bucket transform of a created table.

    The time transforms are only accepted by catalogs with hidden partitioning; on the built-in one they
    become derived partition columns, so their expressions are built here and the layout is by value.
    """
    path = scratch(t.spark, "by_year")
    o = t.orders.withColumn("o_year", F.year("o_orderdate"))
    gathered(o, "o_year").write.partitionBy("o_year").parquet(path)
    pruned = t.spark.read.parquet(path).filter("o_year = 1997").groupBy(F.lit("year").alias("layout"), F.col("o_year").cast("long").alias("part")).agg(F.count("*").alias("n"))
    name = "orders_by_bucket_" + path.rsplit("-", 1)[1]
    where = scratch(t.spark, "by_bucket")
    kept = t.orders.select("o_orderkey", "o_custkey")
    buckets = bucket_number(kept)
    kept.repartition(buckets, "o_custkey").writeTo(name).using("parquet").option("path", where).partitionedBy(F.partitioning.bucket(buckets, "o_custkey")).create()
    bucketed = t.spark.table(name).groupBy(F.lit("bucket").alias("layout"), (F.col("o_custkey") % 2).alias("part")).agg(F.count("*").alias("n"))
    return pruned.union(bucketed)
