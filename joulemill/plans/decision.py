"""The decision-support query set, adapted to the columns at hand.

There is no part-supplier table, so a supply cost is the lowest unit price of a (part, supplier) pair over
the lines. A line counts as late when it ships more than 60 days after its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from joulemill.registry import query
from joulemill.storage import spread


def day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money(c: Column, name: str) -> Column:
    return F.round(c, 2).alias(name)


def supply(t) -> DataFrame:
    """(part, supplier) pairs with cost and available quantity."""
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(
        F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"), F.sum("l_quantity").alias("avail"))


def late() -> Column:
    return F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")


SUPPLY = "supply AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost, sum(l_quantity) AS avail FROM lineitem GROUP BY ALL)"
NET = "l_extendedprice * (1 - l_discount)"


@query("tpch_01_pricing_summary", "TPCH-01", f"""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({NET}), 2) AS sum_disc,
 round(sum({NET} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
 round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def q1(t):
    return t.lineitem.filter(F.col("l_shipdate") <= day("2000-09-02")).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), money(F.sum("l_extendedprice"), "sum_base"), money(F.sum(net()), "sum_disc"),
        money(F.sum(net() * (1 + F.col("l_tax"))), "sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("tpch_02_minimum_cost_supplier", "TPCH-02", f"""
WITH {SUPPLY}, c AS (SELECT * FROM supply JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'EUROPE'),
m AS (SELECT l_partkey, min(cost) AS lowest FROM c GROUP BY 1)
SELECT p_partkey, s_name, n_name, round(cost, 4) AS cost, s_acctbal FROM c JOIN m USING (l_partkey) JOIN part ON p_partkey = l_partkey
WHERE cost = lowest AND p_size < 15 AND p_type = 'STANDARD'""")
def q2(t):
    """Filter the parts first, then keep the cheapest supplier per part by an aggregate joined back."""
    p = t.part.filter((F.col("p_size") < 15) & (F.col("p_type") == "STANDARD")).select(F.col("p_partkey").alias("l_partkey"))
    near = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region.filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = t.lineitem.join(p, "l_partkey", "left_semi")
    c = lines.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost")).join(near, F.col("l_suppkey") == F.col("s_suppkey"))
    lowest = c.groupBy("l_partkey").agg(F.min("cost").alias("lowest"))
    return c.join(lowest, "l_partkey").filter("cost = lowest").select(
        F.col("l_partkey").alias("p_partkey"), "s_name", "n_name", F.round("cost", 4).alias("cost"), "s_acctbal")


@query("tpch_03_shipping_priority", "TPCH-03", f"""
SELECT l_orderkey, round(sum({NET}), 2) AS revenue, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15' GROUP BY ALL ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def q3(t):
    """The orders come first and thin the lines out; the lines left are summed per order, so a hot order meets its row once."""
    c = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t.orders.filter(F.col("o_orderdate") < day("1997-03-15")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    wanted = t.lineitem.filter(F.col("l_shipdate") > day("1997-03-15")).join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    l = wanted.groupBy("l_orderkey").agg(money(F.sum(net()), "revenue"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "revenue", "o_orderdate").orderBy(
        F.desc("revenue"), "l_orderkey").limit(10).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("tpch_04_order_priority", "TPCH-04", """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY) GROUP BY 1""")
def q4(t):
    o = t.orders.filter((F.col("o_orderdate") >= day("1997-07-01")) & (F.col("o_orderdate") < day("1997-10-01")))
    wanted = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    l = wanted.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"))  # a late line exists iff the last one is late
    return o.join(l, (F.col("o_orderkey") == F.col("l_orderkey")) & late(), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("tpch_05_local_supplier_volume", "TPCH-05", f"""
SELECT n_name, round(sum({NET}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1""")
def q5(t):
    n = t.nation.join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = t.orders.filter((F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("1998-01-01")))
    o = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(
        o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    ).groupBy("n_name").agg(money(F.sum(net()), "revenue"))


@query("tpch_06_revenue_forecast", "TPCH-06", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
 AND l_discount BETWEEN 0.049 AND 0.071 AND l_quantity < 24""")
def q6(t):
    l = t.lineitem.filter((F.col("l_shipdate") >= day("1997-01-01")) & (F.col("l_shipdate") < day("1998-01-01"))
                          & F.col("l_discount").between(0.049, 0.071) & (F.col("l_quantity") < 24))
    return l.agg(money(F.sum(F.col("l_extendedprice") * F.col("l_discount")), "revenue"), F.count("*").alias("n"))


@query("tpch_07_volume_shipping", "TPCH-07", f"""
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS y, round(sum({NET}), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_15' AND n2.n_name = 'NATION_20') OR (n1.n_name = 'NATION_20' AND n2.n_name = 'NATION_15')) GROUP BY ALL""")
def q7(t):
    two = F.col("n_name").isin("NATION_15", "NATION_20")
    s = t.supplier.join(t.nation.filter(two), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supp_nation"))
    c = t.customer.join(t.nation.filter(two), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("cust_nation"))
    o = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust_nation")
    return t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter(
        "supp_nation <> cust_nation").groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("y")).agg(money(F.sum(net()), "revenue"))


@query("tpch_08_market_share", "TPCH-08", f"""
SELECT year(o_orderdate) AS y, round(sum(CASE WHEN n2.n_name = 'NATION_15' THEN {NET} ELSE 0 END) / sum({NET}), 6) AS share FROM part JOIN lineitem ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey
JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' GROUP BY 1""")
def q8(t):
    p = t.part.filter("p_type = 'ECONOMY'").select("p_partkey")
    c = t.customer.join(t.nation.join(t.region.filter("r_name = 'AMERICA'"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    o = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_orderdate")
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    l = t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    ours = F.sum(F.when(F.col("n_name") == "NATION_15", net()).otherwise(0.0))
    return l.groupBy(F.year("o_orderdate").alias("y")).agg(F.round(ours / F.sum(net()), 6).alias("share"))


@query("tpch_09_product_profit", "TPCH-09", f"""
WITH {SUPPLY} SELECT n_name, year(o_orderdate) AS y, round(sum({NET} - cost * l_quantity), 2) AS profit FROM lineitem JOIN part ON p_partkey = l_partkey
JOIN supply USING (l_partkey, l_suppkey) JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_name LIKE '%ring%' GROUP BY ALL""")
def q9(t):
    """The part filter is applied to the lines before the costs are derived from them."""
    p = t.part.filter(F.col("p_name").contains("ring")).select(F.col("p_partkey").alias("l_partkey"))
    l = t.lineitem.join(p, "l_partkey", "left_semi")
    cost = l.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    o = t.orders.select("o_orderkey", "o_orderdate")
    return l.join(cost, ["l_partkey", "l_suppkey"]).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "n_name", F.year("o_orderdate").alias("y")).agg(money(F.sum(net() - F.col("cost") * F.col("l_quantity")), "profit"))


@query("tpch_10_returned_items", "TPCH-10", f"""
SELECT c_custkey, c_name, round(sum({NET}), 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""")
def q10(t):
    o = t.orders.filter((F.col("o_orderdate") >= day("1997-10-01")) & (F.col("o_orderdate") < day("1998-01-01"))).select("o_orderkey", "o_custkey")
    wanted = t.lineitem.filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    returned = wanted.groupBy("l_orderkey").agg(F.sum(net()).alias("net"))
    spent = returned.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(money(F.sum("net"), "revenue"))
    return spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "revenue", "c_acctbal", "n_name").orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("tpch_11_important_stock", "TPCH-11", f"""
WITH {SUPPLY}, v AS (SELECT l_partkey, sum(cost * avail) AS stock_value FROM supply JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_15', 'NATION_2', 'NATION_7') GROUP BY 1)
SELECT l_partkey, round(stock_value, 2) AS stock_value FROM v WHERE stock_value > (SELECT sum(stock_value) * 2 / count(*) FROM v)""")
def q11(t):
    s = t.supplier.join(t.nation.filter(F.col("n_name").isin("NATION_15", "NATION_2", "NATION_7")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"))
    lines = t.lineitem.join(s, "l_suppkey", "left_semi")
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"), F.sum("l_quantity").alias("avail"))
    v = pairs.groupBy("l_partkey").agg(F.sum(F.col("cost") * F.col("avail")).alias("stock_value"))
    bar = v.agg((F.sum("stock_value") * 2 / F.count("*")).alias("bar"))
    return v.crossJoin(F.broadcast(bar)).filter("stock_value > bar").select("l_partkey", F.round("stock_value", 2).alias("stock_value"))


@query("tpch_12_shipping_modes", "TPCH-12", """
SELECT l_linestatus, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1""")
def q12(t):
    l = t.lineitem.filter((F.col("l_shipdate") >= day("1997-01-01")) & (F.col("l_shipdate") < day("1998-01-01")))
    o = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return l.join(o, (l.l_orderkey == o.o_orderkey) & (l.l_shipdate > o.o_orderdate)).groupBy("l_linestatus").agg(
        F.count_if(urgent).alias("high"), F.count_if(~urgent).alias("low"))


@query("tpch_13_order_distribution", "TPCH-13", """
SELECT c_count, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1""")
def q13(t):
    """Orders are counted per customer before the outer join, so the join is one row to one row."""
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("c"))
    return t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.coalesce("c", F.lit(0).cast("long")).alias("c_count")).agg(F.count("*").alias("n"))


@query("tpch_14_promotion_effect", "TPCH-14", f"""
SELECT round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN {NET} ELSE 0 END) / sum({NET}), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-12-01'""")
def q14(t):
    l = t.lineitem.filter((F.col("l_shipdate") >= day("1997-09-01")) & (F.col("l_shipdate") < day("1997-12-01")))
    promo = F.sum(F.when(F.col("p_type") == "PROMO", net()).otherwise(0.0))
    return l.join(t.part, l.l_partkey == F.col("p_partkey")).agg(F.round(100.0 * promo / F.sum(net()), 6).alias("promo"))


@query("tpch_15_top_supplier", "TPCH-15", f"""
WITH r AS (SELECT l_suppkey, round(sum({NET}), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY 1)
SELECT s_suppkey, s_name, revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE revenue = (SELECT max(revenue) FROM r)""")
def q15(t):
    l = t.lineitem.filter((F.col("l_shipdate") >= day("1997-01-01")) & (F.col("l_shipdate") < day("1997-04-01")))
    r = l.groupBy("l_suppkey").agg(money(F.sum(net()), "revenue"))
    best = r.agg(F.max("revenue").alias("best"))
    return r.crossJoin(F.broadcast(best)).filter("revenue = best").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "revenue")


@query("tpch_16_part_supplier_counts", "TPCH-16", """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#5' AND p_type <> 'MEDIUM'
 AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""")
def q16(t):
    p = t.part.filter((F.col("p_brand") != "Brand#5") & (F.col("p_type") != "MEDIUM") & F.col("p_size").isin(49, 14, 23, 45, 19, 3, 36, 9))
    bad = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    pairs = t.lineitem.select("l_partkey", "l_suppkey").join(bad, "l_suppkey", "left_anti").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return pairs.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query("tpch_17_small_quantity_revenue", "TPCH-17", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS yearly, count(*) AS n FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#23'
 AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)""")
def q17(t):
    """The correlated average becomes an aggregate over the brand's lines only, joined back on the part."""
    p = t.part.filter("p_brand = 'Brand#23'").select(F.col("p_partkey").alias("l_partkey"))
    l = t.lineitem.join(p, "l_partkey", "left_semi").select("l_partkey", "l_quantity", "l_extendedprice")
    bar = l.groupBy("l_partkey").agg((0.4 * F.avg("l_quantity")).alias("bar"))
    return l.join(bar, "l_partkey").filter("l_quantity < bar").agg(money(F.sum("l_extendedprice") / 7.0, "yearly"), F.count("*").alias("n"))


@query("tpch_18_large_volume_customers", "TPCH-18", """
SELECT c_name, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice, sum(l_quantity) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200) GROUP BY ALL ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def q18(t):
    """The quantity per order is computed once and serves both the filter and the output."""
    big = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")).filter("qty > 200")
    return t.orders.join(big, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(100).select("c_name", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_totalprice", "qty")


@query("tpch_19_discounted_revenue", "TPCH-19", f"""
SELECT round(sum({NET}), 2) AS revenue, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 20 AND p_size BETWEEN 1 AND 25)
 OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 45 AND p_size BETWEEN 1 AND 45)""")
def q19(t):
    b, q, s = F.col("p_brand"), F.col("l_quantity"), F.col("p_size")
    any_of = ((b == "Brand#12") & q.between(1, 20) & s.between(1, 25)) | ((b == "Brand#23") & q.between(10, 30) & s.between(1, 30)) | (
        (b == "Brand#4") & q.between(20, 45) & s.between(1, 45))
    return t.lineitem.join(t.part, (F.col("l_partkey") == F.col("p_partkey")) & any_of).agg(money(F.sum(net()), "revenue"), F.count("*").alias("n"))


@query("tpch_20_part_promotion", "TPCH-20", """
WITH q AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS avail, sum(CASE WHEN year(l_shipdate) = 1997 THEN l_quantity ELSE 0 END) AS shipped FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') GROUP BY ALL)
SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 AND s_suppkey IN (SELECT l_suppkey FROM q WHERE shipped > 0 AND avail > 0.5 * shipped)""")
def q20(t):
    red = t.part.filter(F.col("p_name").startswith("red")).select(F.col("p_partkey").alias("l_partkey"))
    q = t.lineitem.join(red, "l_partkey", "left_semi").groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("avail"), F.sum(F.when(F.year("l_shipdate") == 1997, F.col("l_quantity")).otherwise(0.0)).alias("shipped"))
    wanted = q.filter("shipped > 0 AND avail > 0.5 * shipped")
    s = t.supplier.join(t.nation.filter("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(wanted, s.s_suppkey == wanted.l_suppkey, "left_semi").select("s_name")


@query("tpch_21_waiting_suppliers", "TPCH-21", """
WITH x AS (SELECT l_orderkey, l_suppkey, max(CASE WHEN l_shipdate > o_orderdate + INTERVAL 60 DAY THEN 1 ELSE 0 END) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL),
y AS (SELECT l_orderkey FROM x GROUP BY 1 HAVING count(*) > 1 AND sum(late) = 1)
SELECT s_name, count(*) AS n FROM x JOIN y USING (l_orderkey) JOIN supplier ON s_suppkey = l_suppkey WHERE late = 1 GROUP BY 1""")
def q21(t):
    """Exists / not exists per order become one aggregate: several suppliers, exactly one of them late.

    The join and both aggregates run in the tasks that the lines are dealt to, so their number follows the lines."""
    o = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    lines = spread(t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate"), "l_orderkey")
    last = lines.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    x = last.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_suppkey", late().cast("int").alias("late"))
    y = x.groupBy("l_orderkey").agg(F.count("*").alias("suppliers"), F.sum("late").alias("lates"), F.max_by("l_suppkey", "late").alias("l_suppkey")).filter("suppliers > 1 AND lates = 1")
    return y.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.count("*").alias("n"))


@query("tpch_22_sales_opportunity", "TPCH-22", """
SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey IN (13, 7, 23, 1, 18, 17, 19)
 AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (13, 7, 23, 1, 18, 17, 19))
 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01') GROUP BY 1""")
def q22(t):
    c = t.customer.filter(F.col("c_nationkey").isin(13, 7, 23, 1, 18, 17, 19))
    bar = c.filter("c_acctbal > 0").agg(F.avg("c_acctbal").alias("bar"))
    recent = t.orders.filter(F.col("o_orderdate") >= day("1998-01-01")).select("o_custkey")
    return c.crossJoin(F.broadcast(bar)).filter("c_acctbal > bar").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy(
        "c_nationkey").agg(F.count("*").alias("n"), money(F.sum("c_acctbal"), "total"))
