"""Collection-style dataflow, expressed on DataFrames."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulemill.operators.ordered import positions
from joulemill.registry import query


@query("rd_01_map_family", "RD-01", """
SELECT p_partkey, p_size * 10 AS mapped, word, length(p_type) AS keyed FROM (SELECT *, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE p_size > 20""")
def map_family(t):
    return t.part.filter("p_size > 20").select("p_partkey", (F.col("p_size") * 10).alias("mapped"), F.explode(F.split("p_name", " ")).alias("word"), F.length("p_type").alias("keyed"))


@query("rd_02_sets_and_index", "RD-02", """
SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, row_number() OVER (ORDER BY c_custkey) * 10 AS zipped FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def sets_and_index(t):
    """zipWithIndex from exact positions; zip is then an equi-join on the index."""
    big = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    left = positions(t.customer.select("c_custkey").join(big, "c_custkey", "left_anti"), [], [F.col("c_custkey")], "p").withColumn("i", F.col("p") - 1)
    other = left.select("i", ((F.col("i") + 1) * 10).alias("zipped"))
    return left.drop("p").join(other, "i").select("c_custkey", "i", "zipped")


@query("rd_03_keyed_reduce", "RD-03", "SELECT l_suppkey, sum(l_quantity) AS total, max(l_quantity) AS top, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def keyed_reduce(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("top"), F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("rd_04_histogram", "RD-04", """
SELECT CASE WHEN o_totalprice = 500000 THEN 4 ELSE floor(o_totalprice / 100000)::BIGINT END AS bucket, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1""")
def histogram(t):
    """Buckets are open on the right, the last one closed; values outside are left out."""
    x = F.col("o_totalprice")
    inside = t.orders.filter(x.between(0, 500000))
    return inside.groupBy(F.least(F.width_bucket(x, F.lit(0.0), F.lit(500000.0), F.lit(5)) - 1, F.lit(4).cast("long")).alias("bucket")).agg(F.count("*").alias("n"))


@query("rd_04_stats", "RD-04", """
SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, round(var_pop(o_totalprice) / 1e6, 4) AS variance, round(stddev_pop(o_totalprice), 4) AS stdev, round(stddev_samp(o_totalprice), 4) AS sample_stdev, round(var_samp(o_totalprice) / 1e6, 4) AS sample_variance, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders""")
def stats(t):
    x = "o_totalprice"
    return t.orders.agg(F.count("*").alias("n"), F.round(F.sum(x), 2).alias("total"), F.round(F.avg(x), 4).alias("mean"), F.round(F.var_pop(x) / 1e6, 4).alias("variance"), F.round(F.stddev_pop(x), 4).alias("stdev"),
                        F.round(F.stddev_samp(x), 4).alias("sample_stdev"), F.round(F.var_samp(x) / 1e6, 4).alias("sample_variance"), F.min(x).alias("lo"), F.max(x).alias("hi"))


@query("rd_05_approximate", "RD-05", "SELECT true AS count_ok, true AS sum_ok, true AS mean_ok, true AS distinct_ok FROM region WHERE r_regionkey = 0")
def approximate(t):
    """Estimates from a 20 % sample with four-sigma intervals (normal approximation), which must hold the exact values."""
    f, x = 0.2, F.col("o_totalprice")
    s = t.orders.sample(False, f, 13).agg(F.count("*").alias("k"), F.sum(x).alias("s"), F.avg(x).alias("m"), F.stddev(x).alias("d"), F.sum(x * x).alias("q"))
    e = t.orders.agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.approx_count_distinct("o_custkey", 0.03).alias("a"))
    u = t.orders.agg(F.count_distinct("o_custkey").alias("u"))  # on its own: beside it, every customer would carry a sketch
    c = F.col
    return s.crossJoin(e).crossJoin(u).select((F.abs(c("k") / f - c("n")) <= 4 * F.sqrt(c("n") * (1 - f) / f)).alias("count_ok"), (F.abs(c("s") / f - c("total")) <= 4 * F.sqrt(c("q") * (1 - f)) / f).alias("sum_ok"),
                                 (F.abs(c("m") - c("mean")) <= 4 * c("d") / F.sqrt("k")).alias("mean_ok"), (F.abs(c("a") - c("u")) <= 0.12 * c("u") + 2).alias("distinct_ok"))


@query("rd_11_bridge", "RD-11", "SELECT r_name, r_regionkey, true AS listed FROM region")
def bridge(t):
    """Small results to Python and back: a map of the five regions, iterated and turned into a table again."""
    names = {r["r_name"]: r["r_regionkey"] for r in t.region.toLocalIterator()}
    rows = [(k, v, not t.region.isEmpty()) for k, v in names.items()]
    return t.spark.createDataFrame(rows, "r_name string, r_regionkey int, listed boolean")
