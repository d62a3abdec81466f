"""Aggregation, grouping sets, statistics and sampling."""

from __future__ import annotations

from pyspark.sql import Column, Observation, Window, functions as F

from joulemill.operators.exact import exact_avg, rounded
from joulemill.operators.ordered import attach, one_per_key, percentiles
from joulemill.registry import query
from joulemill.storage import checked_broadcast, cut
from joulemill.tables import Tables


@query("agm_01_group_by", "AGM-01", """
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_q, round(avg(l_tax), 6) AS avg_tax, max(l_extendedprice) AS max_p,
 min(l_extendedprice) AS min_p, round(sum(l_quantity), 2) AS sum_q, max(l_linenumber) AS top_line FROM lineitem GROUP BY 1""")
def group_by(t):
    """All aggregates of a grouping in one pass."""
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.mean("l_quantity"), 6).alias("mean_q"), F.round(F.avg("l_tax"), 6).alias("avg_tax"), F.max("l_extendedprice").alias("max_p"),
        F.min("l_extendedprice").alias("min_p"), F.round(F.sum("l_quantity"), 2).alias("sum_q"), F.max("l_linenumber").alias("top_line"))


@query("agm_05_short_forms", "AGM-05 AGM-06 AGM-07 AGM-08 AGM-09 AGM-10 AGM-11", """
SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(avg(c_acctbal), 6) AS avg, max(c_acctbal) AS max, min(c_acctbal) AS min, round(sum(c_acctbal), 2) AS sum, max(c_custkey) AS last
FROM customer GROUP BY 1""")
def short_forms(t):
    """The methods of a grouping, put side by side by key, on the smaller table; each is a pass of its own."""
    g = t.customer.select("c_nationkey", "c_acctbal", "c_custkey").groupBy("c_nationkey")
    parts = [g.count().toDF("c_nationkey", "n"), g.mean("c_acctbal").toDF("c_nationkey", "mean"), g.avg("c_acctbal").toDF("c_nationkey", "avg"), g.max("c_acctbal").toDF("c_nationkey", "max"),
             g.min("c_acctbal").toDF("c_nationkey", "min"), g.sum("c_acctbal").toDF("c_nationkey", "sum"), g.agg({"c_custkey": "max"}).toDF("c_nationkey", "last")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "c_nationkey")
    return out.withColumns({"mean": F.round("mean", 6), "avg": F.round("avg", 6), "sum": F.round("sum", 2)})


SETS = "coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, grouping_id(l_returnflag, l_linestatus) AS gid, count(*) AS n, round(sum(l_quantity), 2) AS q"


@query("agm_02_rollup", "AGM-02", f"SELECT {SETS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t):
    return _grouping_sets(t.lineitem.rollup("l_returnflag", "l_linestatus"))


@query("agm_03_cube", "AGM-03 AGG-9", f"SELECT {SETS}, grouping(l_returnflag)::BIGINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return _grouping_sets(t.lineitem.cube("l_returnflag", "l_linestatus"), F.grouping("l_returnflag").cast("long").alias("g"))


def _grouping_sets(grouped, *extra):
    star = F.lit("*")
    return grouped.agg(F.grouping_id("l_returnflag", "l_linestatus").alias("gid"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), *extra).select(
        F.coalesce("l_returnflag", star).alias("flag"), F.coalesce("l_linestatus", star).alias("status"), "gid", "n", "q", *["g" for _ in extra])


@query("agm_03_grouping_sets", "AGM-03", f"SELECT {SETS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def grouping_sets(t):
    t.views("lineitem")
    return t.spark.sql(f"SELECT {SETS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")


@query("agm_04_global", "AGM-04 AGM-15", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate)::DATE::VARCHAR AS latest, count(*) AS counted FROM orders")
def global_agg(t):
    return t.orders.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
                        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest")).withColumn("counted", F.lit(t.orders.count()).cast("long"))


@query("agm_12_pivot", "AGM-12", """
SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS F, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS O,
 sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS P FROM orders GROUP BY 1""")
def pivot(t):
    """With the value list given, no extra pass is needed to find it."""
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("agm_13_distinct", "AGM-13", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("agm_14_drop_duplicates", "AGM-14", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1""")
def drop_duplicates(t):
    """A stable choice per key by aggregation; the built-in form keeps an arbitrary row of the same keys."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kept = one_per_key(rows, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])
    keys = rows.dropDuplicates(["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")
    return kept.join(keys, ["l_orderkey", "l_linenumber"], "left_semi").drop("l_extendedprice")


@query("agm_16_describe", "AGM-16", """
SELECT 'count' AS summary, count(l_quantity)::DOUBLE AS quantity, count(l_discount)::DOUBLE AS discount FROM lineitem
UNION ALL SELECT 'mean', round(avg(l_quantity), 6), round(avg(l_discount), 6) FROM lineitem
UNION ALL SELECT 'stddev', round(stddev_samp(l_quantity), 6), round(stddev_samp(l_discount), 6) FROM lineitem
UNION ALL SELECT 'min', min(l_quantity), min(l_discount) FROM lineitem UNION ALL SELECT 'max', max(l_quantity), max(l_discount) FROM lineitem""")
def describe(t):
    d = t.lineitem.describe("l_quantity", "l_discount")
    return d.select("summary", F.round(F.col("l_quantity").cast("double"), 6).alias("quantity"), F.round(F.col("l_discount").cast("double"), 6).alias("discount"))


@query("agm_17_summary", "AGM-17")
def summary(t):
    return t.lineitem.select("l_quantity", "l_extendedprice").summary("count", "min", "25%", "50%", "75%", "max", "mean", "stddev")


QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


@query("agm_17_exact_summary", "AGM-17", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c})::DOUBLE AS count, min({c}) AS min, max({c}) AS max, round(avg({c})::DECIMAL(38,9), 4)::DOUBLE AS mean, round(stddev_samp({c}), 4) AS stddev, " + ", ".join(f'round(quantile_cont({c}, {q})::DECIMAL(38,9), 4)::DOUBLE AS "{n}"' for n, q in QUARTILES.items()) + " FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def exact_summary(t):
    """The statistics of ``summary`` with exact quartiles, which stay distributed, for all columns in one pass over long rows."""
    columns = ["l_quantity", "l_extendedprice"]
    long = t.lineitem.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in columns])).alias("c")).select("c.*")
    moments = long.groupBy("name").agg(F.count("x").cast("double").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), rounded(exact_avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("stddev"))
    quartiles = percentiles(long, ["name"], "x", {f"q{i}": q for i, q in enumerate(QUARTILES.values())})
    return moments.join(quartiles.select("name", *[rounded(f"q{i}", 4).alias(n) for i, n in enumerate(QUARTILES)]), "name")


@query("agm_18_observe", "AGM-18 AGM-19", "SELECT count(*) AS rows_seen, sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END)::BIGINT AS big, count(DISTINCT o_custkey) AS customers FROM orders")
def observe(t):
    """Quality metrics taken while the job that writes its result runs: no second pass over the rows.

    It runs in a session of its own: one that has observed holds a manager that closures of some fitted
    models, which carry their session, cannot serialize.
    """
    own = Tables(t.spark.newSession(), t.folder)
    seen = Observation("orders")
    watched = own.orders.observe(seen, F.count(F.lit(1)).alias("rows_seen"), F.count_if(F.col("o_totalprice") > 300000).alias("big"))
    result = cut(watched.groupBy("o_custkey").agg(F.count("*").alias("n")), "observed")
    got = seen.get
    return result.agg(F.lit(got["rows_seen"]).cast("long").alias("rows_seen"), F.lit(got["big"]).cast("long").alias("big"), F.count("*").alias("customers"))


@query("agm_20_approx_quantile", "AGM-20", "SELECT true AS within_bound, count(*) AS n FROM orders")
def approx_quantile(t):
    """Approximate quantiles, checked by their definition: the rank of each answer is within the error."""
    o = t.orders.select("o_totalprice")
    points, error = [0.1, 0.5, 0.9], 0.01
    values = o.approxQuantile("o_totalprice", points, error)
    n = F.count("*")
    good = F.lit(True)
    for p, v in zip(points, values):
        below = F.count_if(F.col("o_totalprice") <= v)
        good = good & (below >= F.floor((p - error) * n)) & (F.count_if(F.col("o_totalprice") < v) <= F.ceil((p + error) * n))
    return o.agg(good.alias("within_bound"), n.alias("n"))


@query("agm_21_corr_cov", "AGM-21 AGM-22", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS corr, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov FROM lineitem")
def corr_cov(t):
    """Both in one pass; the methods of the same name take one pass each and return numbers to the driver."""
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("corr"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 3).alias("cov"))


PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("agm_23_crosstab", "AGM-23", "SELECT p_brand AS p_brand_p_type, " + ", ".join(f"count(*) FILTER (p_type = '{k}') AS {k}" for k in PART_TYPES) + " FROM part GROUP BY 1")
def crosstab(t):
    return t.part.crosstab("p_brand", "p_type")


@query("agm_24_freq_items", "AGM-24", "SELECT c_mktsegment AS item FROM customer GROUP BY 1 HAVING count(*) > 0.15 * (SELECT count(*) FROM customer)")
def freq_items(t):
    """The one-pass candidates may hold false positives; a second pass keeps the truly frequent ones."""
    c = t.customer.select("c_mktsegment")
    found = c.freqItems(["c_mktsegment"], 0.15).select(F.explode("c_mktsegment_freqItems").alias("item"))
    counts = c.groupBy(F.col("c_mktsegment").alias("item")).agg(F.count("*").alias("n"))
    total = c.agg(F.count("*").alias("total"))
    return counts.join(found, "item", "left_semi").crossJoin(total).filter("n > 0.15 * total").select("item")


@query("agm_25_sampling", "AGM-25 AGM-26 AGM-27 RD-08", "SELECT true AS bernoulli, true AS poisson, true AS stratified, true AS split, true AS taken")
def sampling(t):
    """Sampling operators by their properties: sizes near expectation, strata kept, splits that partition."""
    o = t.orders.select("o_orderkey", "o_orderpriority")
    n = o.count()
    s = o.sample(False, 0.4, 7).count()
    r = o.sample(withReplacement=True, fraction=1.5, seed=7).count()
    by = o.sampleBy("o_orderpriority", {"1-URGENT": 1.0, "2-HIGH": 0.3}, 7).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.count_if(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))).first()
    urgent = o.filter("o_orderpriority = '1-URGENT'").count()
    a, b = o.randomSplit([0.7, 0.3], 7)
    whole = a.select("o_orderkey").union(b.select("o_orderkey")).agg(F.count("*"), F.count_distinct("o_orderkey")).first()
    taken = o.orderBy(F.rand(3)).limit(25).count()
    near = lambda got, want: abs(got - want) < 6 * (want + 1) ** 0.5
    flags = {"bernoulli": near(s, 0.4 * n), "poisson": near(r, 1.5 * n), "stratified": by[0] == urgent and by[1] == 0,
             "split": whole[0] == n and whole[1] == n, "taken": taken == min(25, n)}
    return t.spark.range(1).select(*[F.lit(bool(v)).alias(k) for k, v in flags.items()])


@query("agg_1_basic", "AGG-1", """
SELECT l_returnflag, l_linestatus, count(l_tax) AS n, round(sum(l_tax), 4) AS s, round(avg(l_tax), 6) AS a, max(l_tax) AS mx, min(l_tax) AS mn,
 count(*) FILTER (l_discount > 0.05) AS discounted, quantile_cont(l_quantity, 0.5) AS med, round(max_by(l_quantity, l_extendedprice), 2) AS at_max,
 round(min_by(l_quantity, l_extendedprice), 2) AS at_min, 1 AS same, round(exp(sum(ln(1 + l_tax))) / exp(sum(ln(1 + l_tax))), 6) AS prod_ok,
 (SELECT m FROM (SELECT l_returnflag AS f, l_linestatus AS g, l_quantity AS m, count(*) AS c FROM lineitem GROUP BY ALL) x WHERE f = l.l_returnflag AND g = l.l_linestatus ORDER BY c DESC, m LIMIT 1) AS common
FROM lineitem l GROUP BY ALL""")
def basic(t):
    """mode breaks ties downwards here so the oracle can follow; first/last/any_value see one-valued groups."""
    l = t.lineitem
    flag = F.col("l_returnflag")
    same = [F.first("l_returnflag"), F.last("l_returnflag", True), F.first_value("l_returnflag"), F.last_value("l_returnflag"), F.any_value("l_returnflag")]
    agree = F.lit(True)
    for x in same:
        agree = agree & (x == F.min(flag))
    logs = F.exp(F.sum(F.log1p("l_tax")))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("l_tax").alias("n"), F.round(F.sum("l_tax"), 4).alias("s"), F.round(F.mean("l_tax"), 6).alias("a"), F.max("l_tax").alias("mx"),
        F.min("l_tax").alias("mn"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.median("l_quantity").alias("med"),
        F.max_by("l_quantity", "l_extendedprice").alias("at_max"), F.min_by("l_quantity", "l_extendedprice").alias("at_min"),
        agree.cast("int").alias("same"), F.round(F.product(F.col("l_tax") * 0 + 1) * logs / logs, 6).alias("prod_ok"), F.mode("l_quantity", True).alias("common"))


@query("agg_1_ordered", "AGG-1", """
WITH l AS (SELECT l_orderkey, l_quantity AS q, CASE WHEN l_discount > 0.05 THEN l_quantity END AS c, row_number() OVER w AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS j
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT l_orderkey, arg_min(q, i) AS first, arg_min(q, j) AS last, coalesce(arg_min(c, i) FILTER (c IS NOT NULL), -1) AS first_cheap, coalesce(arg_min(c, j) FILTER (c IS NOT NULL), -1) AS last_cheap, arg_min(q, i) AS any, product(q) AS product FROM l GROUP BY 1""")
def ordered(t):
    """First and last in line order, with and without nulls, and the product, per order of a few lines."""
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    w = Window.partitionBy("l_orderkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cheap = F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))
    l = t.lineitem.select("l_orderkey", *[c for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")])
    l = l.withColumns({
        "first": F.first("l_quantity").over(w), "last": F.last("l_quantity").over(w), "first_cheap": F.first(cheap, ignorenulls=True).over(w), "last_cheap": F.last_value(cheap, F.lit(True)).over(w),
        "any": F.when(F.first_value("l_quantity").over(w) == F.any_value("l_quantity").over(w), F.any_value("l_quantity").over(w))})
    return l.groupBy("l_orderkey", "first", "last", F.coalesce("first_cheap", F.lit(-1.0)).alias("first_cheap"), F.coalesce("last_cheap", F.lit(-1.0)).alias("last_cheap"), "any").agg(F.product("l_quantity").alias("product"))


@query("agg_2_distinct", "AGG-2", """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS d, sum(DISTINCT o_custkey)::BIGINT AS sd, count(DISTINCT (o_custkey, o_orderstatus)) AS pairs, true AS near FROM orders GROUP BY 1""")
def distinct_aggs(t):
    """One row per customer and status first, then per customer: a single set of distinct columns is left, which needs no copy of the rows.

    The sketches are an aggregate of their own, one for each priority: beside the distinct ones, every customer would carry a sketch."""
    pairs = t.orders.groupBy("o_orderpriority", "o_custkey", "o_orderstatus").agg(F.lit(1).alias("one"))
    customers = pairs.groupBy("o_orderpriority", "o_custkey").agg(F.count(F.when(F.col("o_custkey").isNotNull() & F.col("o_orderstatus").isNotNull(), 1)).alias("pairs"))
    exact = customers.groupBy("o_orderpriority").agg(
        F.countDistinct("o_custkey").alias("d"), F.count_distinct("o_custkey").alias("_d"), F.when(F.sumDistinct("o_custkey") == F.sum_distinct("o_custkey"), F.sum_distinct("o_custkey")).alias("sd"), F.sum("pairs").alias("pairs"))
    sketched = t.orders.groupBy("o_orderpriority").agg(F.greatest(F.approx_count_distinct("o_custkey", 0.02), F.approxCountDistinct("o_custkey", 0.02)).alias("_a"))
    d = F.col("_d")
    return attach(exact, sketched, ["o_orderpriority"]).select("o_orderpriority", "d", "sd", "pairs", (F.abs(F.col("_a") - d) <= F.greatest(d * 0.1, F.lit(2))).alias("near"))


@query("agg_3_statistics", "AGG-3", """
WITH x AS (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS p, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS d FROM lineitem)
SELECT l_returnflag, round(stddev_samp(q), 6) AS sd, round(stddev_pop(q), 6) AS sdp, round(var_samp(q), 5) AS v, round(var_pop(q), 5) AS vp,
 round((sum(d * d * d) / count(*)) / pow(sum(d * d) / count(*), 1.5), 6) AS skew, round((sum(d * d * d * d) / count(*)) / pow(sum(d * d) / count(*), 2) - 3, 6) AS kurt,
 round(corr(q, p), 6) AS c, round(covar_pop(q, p), 2) AS cp, round(covar_samp(q, p), 2) AS cs FROM x GROUP BY 1""")
def statistics(t):
    q, p = "l_quantity", "l_extendedprice"
    same = (F.stddev(q) == F.stddev_samp(q)) & (F.std(q) == F.stddev_samp(q)) & (F.variance(q) == F.var_samp(q))
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.when(same, F.stddev_samp(q)), 6).alias("sd"), F.round(F.stddev_pop(q), 6).alias("sdp"), F.round(F.var_samp(q), 5).alias("v"),
        F.round(F.var_pop(q), 5).alias("vp"), F.round(F.skewness(q), 6).alias("skew"), F.round(F.kurtosis(q), 6).alias("kurt"),
        F.round(F.corr(q, p), 6).alias("c"), F.round(F.covar_pop(q, p), 2).alias("cp"), F.round(F.covar_samp(q, p), 2).alias("cs"))


@query("agg_4_regression", "AGG-4", """
SELECT l_returnflag, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay,
 round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
 round(regr_sxx(l_extendedprice, l_quantity), 1) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1e6, 4) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1e9, 4) AS syy FROM lineitem GROUP BY 1""")
def regression(t):
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(
        F.regr_count(y, x).alias("n"), F.round(F.regr_avgx(y, x), 6).alias("ax"), F.round(F.regr_avgy(y, x), 3).alias("ay"), F.round(F.regr_slope(y, x), 4).alias("slope"),
        F.round(F.regr_intercept(y, x), 3).alias("icept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(F.regr_sxx(y, x), 1).alias("sxx"),
        F.round(F.regr_sxy(y, x) / 1e6, 4).alias("sxy"), F.round(F.regr_syy(y, x) / 1e9, 4).alias("syy"))


@query("agg_5_boolean_bits", "AGG-5", """
SELECT event_type, bool_and(value > 0) AS all_pos, bool_or(value > 480) AS some_big, bit_and(event_id) AS ba, bit_or(event_id) AS bo, bit_xor(event_id) AS bx FROM events GROUP BY 1""")
def boolean_bits(t):
    pos, big = F.col("value") > 0, F.col("value") > 480
    return t.events.groupBy("event_type").agg(
        (F.every(pos) & F.bool_and(pos)).alias("all_pos"), (F.some(big) & F.bool_or(big)).alias("some_big"), F.bit_and("event_id").alias("ba"),
        F.bit_or("event_id").alias("bo"), F.bit_xor("event_id").alias("bx"))


@query("agg_6_collect", "AGG-6", """
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(y || ':' || n, ',' ORDER BY y) AS per_year, string_agg(DISTINCT n::VARCHAR, ',' ORDER BY n::VARCHAR) AS sizes, count(*) AS years FROM y GROUP BY 1""")
def collect(t):
    """Lists are taken over yearly counts, so their length is bounded by the calendar, not by the orders."""
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return y.groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("y", "n"))).alias("l"), F.sort_array(F.collect_set(F.col("n").cast("string"))).alias("s"),
        F.array_agg("y").alias("a")).select(
        "o_custkey", F.array_join(F.transform("l", lambda e: F.concat(e["y"], F.lit(":"), e["n"])), ",").alias("per_year"), F.array_join("s", ",").alias("sizes"),
        F.size("a").cast("long").alias("years"))


@query("agg_7_quantiles", "AGG-7", """
SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
 true AS near, count(*) AS binned FROM lineitem GROUP BY 1""")
def quantiles(t):
    """Exact percentiles of prices stay distributed; the built-in exact one is kept for the 50 quantities."""
    l = t.lineitem
    exact = percentiles(l.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})
    rest = l.groupBy("l_returnflag").agg(
        F.percentile("l_quantity", 0.25).alias("q1"), F.percentile_approx("l_extendedprice", 0.5, 10000).alias("a"), F.approx_percentile("l_extendedprice", F.lit(0.5), F.lit(10000)).alias("b"),
        F.histogram_numeric("l_quantity", F.lit(5)).alias("h"))
    mass = F.aggregate("h", F.lit(0.0), lambda s, x: s + x["y"])
    return exact.join(rest, "l_returnflag").select(
        "l_returnflag", "q1", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"),
        ((F.abs(F.col("a") - F.col("p50")) < 0.02 * F.col("p50")) & (F.col("a") == F.col("b"))).alias("near"), mass.cast("long").alias("binned"))


@query("agg_8_sketches", "AGG-8", """
SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, true AS near FROM events GROUP BY 1""")
def sketches(t):
    """Daily sketches, merged per type: bitmaps give exact distinct counts, HLL an estimate close to them."""
    e = t.events.withColumn("day", F.to_date("ts"))
    daily = e.groupBy("event_type", "day").agg(F.hll_sketch_agg("user_id", 12).alias("hll"), F.count("*").alias("n"),
                                               F.count_min_sketch("user_id", F.lit(0.1), F.lit(0.9), F.lit(7)).alias("cms"))
    merged = daily.groupBy("event_type").agg(F.hll_union_agg("hll").alias("u"), F.sum("n").alias("n"), F.min(F.length("cms")).alias("cms"))
    maps = e.groupBy("event_type", "day", F.bitmap_bucket_number("user_id").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("m"))
    exact = maps.groupBy("event_type", "b").agg(F.bitmap_count(F.bitmap_or_agg("m")).alias("c")).groupBy("event_type").agg(F.sum("c").alias("users"))
    estimate = F.hll_sketch_estimate(F.hll_union("u", "u"))
    return merged.join(exact, "event_type").select("event_type", "users", "n", ((F.abs(estimate - F.col("users")) <= F.greatest(F.col("users") * 0.1, F.lit(2))) & (F.col("cms") > 0)).alias("near"))


def count_min_estimate(sketch: Column, item: Column) -> Column:
    """Count of an integer ``item`` (0 <= item < 2**32) from the bytes of a count-min sketch: the smallest of its counters, one per row.

    The bytes hold, big-endian: version (4), total (8), depth (4), width (4), a multiplier per row (8 each) and the counters row by row (8 each). A row's
    counter is found by multiplying, adding the upper half of the product to the lower, and taking 31 bits of it modulo the width."""
    number = lambda at, size: F.conv(F.hex(F.substr(sketch, at, F.lit(size))), 16, 10).cast("long")
    depth, width = number(F.lit(13), 4), number(F.lit(17), 4)

    def counter(row: Column) -> Column:
        product = number((F.lit(21) + 8 * row).cast("int"), 8) * item
        cell = F.pmod((product + F.shiftright(product, 32)).bitwiseAND(F.lit(0x7FFFFFFF)), width)
        return number((F.lit(21) + 8 * depth + 8 * (row * width + cell)).cast("int"), 8)

    return F.array_min(F.transform(F.sequence(F.lit(0).cast("long"), depth - 1), counter))


@query("agg_8_count_min", "AGG-8", """
WITH u AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, count(*) AS users, sum(n)::BIGINT AS total, true AS never_below, true AS near FROM u GROUP BY 1""")
def count_min(t):
    """Point queries of one sketch per event type, for every user, held against the true counts: never below them, and at most eps * total above
    them for at least the confidence's share of the users."""
    eps, confidence = 0.005, 0.95
    sketches = t.events.groupBy("event_type").agg(F.count_min_sketch("user_id", F.lit(eps), F.lit(confidence), F.lit(11)).alias("sketch"), F.count("user_id").alias("total"))
    users = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    asked = users.join(checked_broadcast(sketches), "event_type").withColumn("estimate", count_min_estimate(F.col("sketch"), F.col("user_id")))
    over = F.col("estimate") - F.col("n")
    return asked.groupBy("event_type").agg(
        F.count("*").alias("users"), F.sum("n").alias("total"), F.bool_and(over >= 0).alias("never_below"),
        (F.avg((over <= F.ceil(eps * F.col("total"))).cast("int")) >= confidence).alias("near"))


@query("agg_10_safe", "AGG-10", """
SELECT l_returnflag, count(*) > 1 AS overflowed, sum(l_orderkey)::BIGINT AS s, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY 1""")
def safe(t):
    """Each value fits a long, their sum does not: null instead of an error."""
    big = F.lit(9_000_000_000_000_000_000) + F.col("l_linenumber")
    return t.lineitem.groupBy("l_returnflag").agg(F.try_sum(big).isNull().alias("overflowed"), F.try_sum("l_orderkey").alias("s"), F.round(F.try_avg("l_quantity"), 6).alias("a"))
