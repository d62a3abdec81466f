"""Frame-style queries over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, Window, functions as F

from joulemill.frames import ops
from joulemill.operators.ordered import framed, one_per_key, percentiles, positions, ranks, top_per_key
from joulemill.registry import query
from joulemill.storage import cut, scratch

OVER = "(PARTITION BY user_id ORDER BY ts, event_id)"


def by_time():
    return [F.col("ts"), F.col("event_id")]


def r(c, name=None, digits=6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits).alias(name) if name else F.round(c, digits)


def nn(c, name, digits=6, default=-1.0):
    """Rounded, with nulls as -1: null handling must not depend on the driver's conversion."""
    return F.coalesce(F.round(F.col(c) if isinstance(c, str) else c, digits), F.lit(default)).alias(name)


@query("ps_01_elementwise", "PS-01", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - 25) AS a, l_linenumber AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a + b AS "add", a - b AS sub, b - a AS rsub, a * b AS mul, round(a / b, 6) AS div, CASE WHEN a <> 0 THEN round(b / a, 6) ELSE 0 END AS rdiv, floor(a / b)::BIGINT AS floordiv, a - floor(a / b) * b AS mod, pow(b, 2) AS pow, pow(2, b) AS rpow,
 a = b AS eq, a <> b AS ne, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge, round(a / 8, 1) AS rounded, least(greatest(a, -10), 10) AS clip FROM x""")
def elementwise(t):
    a, b = F.col("l_quantity") - 25, F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (a + b).alias("add"), (a - b).alias("sub"), (b - a).alias("rsub"), (a * b).alias("mul"), r(a / b, "div"), F.coalesce(r(F.try_divide(b, a)), F.lit(0.0)).alias("rdiv"),
        ops.floordiv(a, b).alias("floordiv"), ops.floormod(a, b).alias("mod"), F.pow(b, F.lit(2)).alias("pow"), F.pow(F.lit(2), b).alias("rpow"), (a == b).alias("eq"), (a != b).alias("ne"), (a < b).alias("lt"), (a <= b).alias("le"), (a > b).alias("gt"), (a >= b).alias("ge"),
        F.round(a / 8, 1).alias("rounded"), F.least(F.greatest(a, F.lit(-10.0)), F.lit(10.0)).alias("clip"))


@query("ps_02_select_frame", "PS-02", """
SELECT event_id AS x_id_y, user_id AS x_user_y, CASE WHEN value > 100 THEN value ELSE 0 END AS x_where_y, CASE WHEN value > 100 THEN -1 ELSE value END AS x_mask_y, event_type IN ('click', 'view') AS x_member_y, value::VARCHAR IS NULL AS x_isnull_y, 'src' AS x_inserted_y, round(value * 2 + 1, 6) AS x_evaluated_y
FROM events WHERE hour(ts) BETWEEN 9 AND 16 AND value < 300 AND user_id = 7 OR (minute(ts) = 0 AND hour(ts) BETWEEN 9 AND 16 AND value < 300)""")
def select_frame(t):
    e = t.events.withColumn("inserted", F.lit("src")).withColumn("evaluated", F.expr("round(value * 2 + 1, 6)"))  # insert / assign / eval
    e = e.filter(F.hour("ts").between(9, 16)).where("value < 300")  # between_time / query
    at = e.filter((F.minute("ts") == 0))  # at_time on the minute
    user = e.filter((F.col("user_id") == 7) & (F.minute("ts") != 0))  # xs
    e = user.unionByName(at)
    numbers = [c for c, kind in e.dtypes if kind in ("bigint", "double")]  # select_dtypes
    e = e.select("event_type", *numbers, "inserted").withColumns({  # filter(items) / where / mask / isin / isnull / astype
        "where": F.when(F.col("value") > 100, F.col("value")).otherwise(0.0), "mask": F.when(F.col("value") > 100, -1.0).otherwise(F.col("value")),
        "member": F.col("event_type").isin("click", "view"), "isnull": F.col("value").cast("string").isNull(),
    }).drop("value", "event_type").withColumnsRenamed({"event_id": "id", "user_id": "user"})
    return e.toDF(*[f"x_{c}_y" for c in e.columns])  # add_prefix / add_suffix


@query("ps_02_take", "PS-02", """
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) SELECT i, event_id FROM n WHERE i IN (0, 3, 10, 500)""")
def take(t):
    numbered = positions(t.events.select("ts", "event_id"), [], by_time(), "p")
    return numbered.select((F.col("p") - 1).alias("i"), "event_id").filter(F.col("i").isin(0, 3, 10, 500))


@query("ps_03_combine", "PS-03", """
SELECT d.doc_id AS doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END) AS combined, CASE WHEN d.doc_id % 10 = 0 THEN 9 ELSE coalesce(l.quality, -1) END AS updated, 'doc' AS origin FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT item_id + 1000000, 0, -1, 'benchmark' FROM benchmark""")
def combine(t):
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")  # merge / join / align
    own = F.when(F.col("n_chars") > 500, 1).otherwise(0)
    d = d.withColumn("combined", F.coalesce("quality", own)).withColumn("updated", F.when(F.col("doc_id") % 10 == 0, 9).otherwise(F.coalesce("quality", F.lit(-1))))
    d = d.select("doc_id", "combined", "updated", F.lit("doc").alias("origin"))
    return d.unionByName(t.benchmark.select((F.col("item_id") + 1000000).alias("doc_id"), F.lit(0).alias("combined"), F.lit(-1).alias("updated"), F.lit("benchmark").alias("origin")))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
DUMMIES = [f"is_{s.lower()}" for s in SEGMENTS]


@query("ps_05_concat_dummies", "PS-05", """
SELECT 'c' AS side, c_custkey AS id, """ + ", ".join(f"(c_mktsegment = '{s}')::INT AS is_{s.lower()}" for s in SEGMENTS) + """, 'c_acctbal' AS variable, c_acctbal AS amount FROM customer
UNION ALL SELECT 's', s_suppkey, 0, 0, 0, 0, 0, 's_acctbal', s_acctbal FROM supplier""")
def concat_dummies(t):
    c = t.customer.select(F.lit("c").alias("side"), F.col("c_custkey").alias("id"), *[(F.col("c_mktsegment") == s).cast("int").alias(f"is_{s.lower()}") for s in SEGMENTS], "c_acctbal")
    c = c.melt(["side", "id", *DUMMIES], ["c_acctbal"], "variable", "amount")
    s = t.supplier.select(F.lit("s").alias("side"), F.col("s_suppkey").alias("id"), "s_acctbal").melt(["side", "id"], ["s_acctbal"], "variable", "amount")
    return c.unionByName(s, allowMissingColumns=True).fillna(0, DUMMIES)


@query("ps_06_pivot_table", "PS-06", """
SELECT measure, round(sum(CASE WHEN o_orderstatus = 'F' THEN v ELSE 0 END), 2) AS "F", round(sum(CASE WHEN o_orderstatus = 'O' THEN v ELSE 0 END), 2) AS "O", round(sum(CASE WHEN o_orderstatus = 'P' THEN v ELSE 0 END), 2) AS "P"
FROM (SELECT o_orderstatus, 'total' AS measure, o_totalprice AS v FROM orders UNION ALL SELECT o_orderstatus, 'n', 1 FROM orders) GROUP BY 1""")
def pivot_table(t):
    """pivot_table, then its transpose: the aggregate is stacked to long form and pivoted the other way."""
    p = t.orders.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n"))
    long = p.unpivot(["o_orderstatus"], ["total", "n"], "measure", "v")  # stack / melt
    return long.groupBy("measure").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("v"), 2))  # unstack / transpose


@query("ps_06_explode_reindex", "PS-06", """
WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1)
SELECT k AS word, coalesce(n, 0) AS n FROM (VALUES ('red'), ('ring'), ('absent'), ('widget')) v(k) LEFT JOIN c ON word = k""")
def explode_reindex(t):
    counts = t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    index = t.spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in ("red", "ring", "absent", "widget")])).alias("word"))
    return index.join(counts, "word", "left").fillna(0, ["n"])


@query("ps_07_reductions", "PS-07", """
SELECT round(avg(l_quantity), 6) AS mean, sum(l_quantity) AS total, round(skewness(l_tax), 5) AS skew, round(kurtosis(l_tax), 5) AS kurt, min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n, round(stddev_samp(l_quantity), 6) AS std, round(var_samp(l_quantity), 5) AS var, quantile_cont(l_quantity, 0.5) AS median,
 round(stddev_samp(l_quantity) / sqrt(count(*)), 8) AS sem, round(sum(abs(l_quantity - 25)), 2) AS absdev, round(exp(sum(ln(1 + l_tax / 1000))), 6) AS product FROM lineitem""")
def reductions(t):
    q, x = F.col("l_quantity"), F.col("l_tax")
    n = F.count("*")
    return t.lineitem.agg(
        r(F.avg(q), "mean"), F.sum(q).alias("total"), r(ops.sample_skew(n, F.skewness(x)), "skew", 5), r(ops.sample_kurt(n, F.kurtosis(x)), "kurt", 5), F.min(q).alias("lo"), F.max(q).alias("hi"), F.count(q).alias("n"), r(F.stddev_samp(q), "std"), r(F.var_samp(q), "var", 5), F.median(q).alias("median"),
        r(F.stddev_samp(q) / F.sqrt(n), "sem", 8), r(F.sum(F.abs(q - 25)), "absdev", 2), r(F.exp(F.sum(F.log(1 + x / 1000))), "product"))


@query("ps_08_more_reductions", "PS-08", """
SELECT bool_and(l_quantity > 0) AS "all", bool_or(l_discount > 0.09) AS "any", count(DISTINCT l_partkey) AS nunique, (SELECT l_quantity FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
 (SELECT round(avg(abs(l_quantity - m)), 6) FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)) AS mad, (SELECT l_orderkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 1) AS idxmax, (SELECT l_orderkey FROM lineitem ORDER BY l_extendedprice, l_orderkey LIMIT 1) AS idxmin,
 round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_samp(l_quantity, l_tax), 8) AS cov, round(sum(l_quantity * l_tax), 4) AS dot, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90 FROM lineitem""")
def more_reductions(t):
    l = t.lineitem
    mid = l.agg(F.avg("l_quantity").alias("_m"))
    out = l.crossJoin(F.broadcast(mid)).agg(
        F.bool_and(F.col("l_quantity") > 0).alias("all"), F.bool_or(F.col("l_discount") > 0.09).alias("any"), F.count_distinct("l_partkey").alias("nunique"), F.mode("l_quantity", True).alias("mode"), r(F.avg(F.abs(F.col("l_quantity") - F.col("_m"))), "mad"),
        F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"))).alias("idxmax"), F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("idxmin"), r(F.corr("l_quantity", "l_extendedprice"), "corr"), r(F.covar_samp("l_quantity", "l_tax"), "cov", 8),
        r(F.sum(F.col("l_quantity") * F.col("l_tax")), "dot", 4))
    return out.crossJoin(percentiles(l.select("l_extendedprice"), [], "l_extendedprice", {"q90": 0.9})).withColumn("q90", F.round("q90", 4))


@query("ps_09_cumulative", "PS-09 PS-16", f"""
SELECT event_id, round(sum(v) OVER w, 4) AS cumsum, min(v) OVER w AS cummin, max(v) OVER w AS cummax, row_number() OVER {OVER} - 1 AS cumcount,
 round(CASE WHEN sum((v = 0)::INT) OVER w > 0 THEN 0 ELSE CASE WHEN (sum((v < 0)::INT) OVER w) % 2 = 1 THEN -1 ELSE 1 END * exp(sum(ln(abs(nullif(v, 0)))) OVER w) END, 6) + 0.0 AS cumprod
FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 50 = 0 THEN 0.0 WHEN event_id % 3 = 0 THEN -1.0 - (event_id % 5) / 100.0 ELSE 1.0 + (event_id % 7) / 100.0 END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cumulative(t):
    i = F.col("event_id")
    v = F.when(i % 50 == 0, 0.0).when(i % 3 == 0, -1.0 - (i % 5) / 100.0).otherwise(1.0 + (i % 7) / 100.0)
    out = ops.cumulative(t.events.withColumn("v", v), ["user_id"], by_time(), "v")
    return out.select("event_id", r("cumsum", "cumsum", 4), "cummin", "cummax", "cumcount", (F.round("cumprod", 6) + 0.0).alias("cumprod"))


@query("ps_10_order_based", "PS-10 PS-16", f"""
SELECT event_id, coalesce(lag(value) OVER w, -1) AS shift, coalesce(round(value - lag(value) OVER w, 6), -1) AS diff, coalesce(round((value - lag(value) OVER w) / lag(value) OVER w, 6), -1) AS pct,
 round(rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0, 1) AS rank FROM events WINDOW w AS {OVER}""")
def order_based(t):
    s = ops.shifted(t.events, ["user_id"], by_time(), "value")
    s = ranks(s, ["user_id"], "value", "event_id")
    return s.select("event_id", nn("shift", "shift"), nn("diff", "diff"), nn("pct_change", "pct"), r("avg_rank", "rank", 1))


@query("ps_10_top_bottom", "PS-10", """
SELECT 'nlargest' AS form, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL SELECT 'nsmallest', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)
UNION ALL SELECT 'head', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4) UNION ALL SELECT 'tail', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 4)
UNION ALL SELECT 'first', o_orderkey FROM orders WHERE o_orderdate < (SELECT min(o_orderdate) FROM orders) + INTERVAL 3 DAY UNION ALL SELECT 'last', o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 3 DAY""")
def top_bottom(t):
    """Sorted ends are top-k plans; the time-based first and last compare with a one-row min and max."""
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    ends = o.agg(F.min("o_orderdate").alias("_lo"), F.max("o_orderdate").alias("_hi"))
    timed = o.crossJoin(F.broadcast(ends))
    three = F.expr("INTERVAL 3 DAYS")
    forms = {"nlargest": o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5), "nsmallest": o.orderBy("o_totalprice", "o_orderkey").limit(5), "head": o.orderBy("o_orderkey").limit(4), "tail": o.orderBy(F.desc("o_orderkey")).limit(4),
             "first": timed.filter(F.col("o_orderdate") < F.col("_lo") + three), "last": timed.filter(F.col("o_orderdate") > F.col("_hi") - three)}
    out = None
    for form, df in forms.items():
        part = df.select(F.lit(form).alias("form"), "o_orderkey")
        out = part if out is None else out.union(part)
    return out


GAPS = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE value END AS v FROM events)"


@query("ps_11_duplicates_fill", "PS-11 PS-12 PS-16", f"""
WITH g AS (SELECT *, row_number() OVER {OVER} AS p FROM {GAPS}),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS ff, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER w AS pb, first_value(v IGNORE NULLS) OVER u AS bf, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER u AS pa FROM g
 WINDOW w AS (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, coalesce(ff, -1) AS ffill, coalesce(bf, -1) AS bfill, coalesce(round(CASE WHEN v IS NOT NULL THEN v WHEN pa IS NULL THEN ff WHEN pb IS NOT NULL THEN ff + (bf - ff) * (p - pb) / (pa - pb) END, 6), -1) AS interpolate, coalesce(v, 0) AS fillna FROM f""")
def fills(t):
    e = t.events.withColumn("v", F.when(~(F.col("event_id") % 4).isin(1, 2), F.col("value")))
    out = ops.fill(e, ["user_id"], [("ts", True), ("event_id", True)], "v")
    return out.select("event_id", nn("ffill", "ffill"), nn("bfill", "bfill"), nn("interpolate", "interpolate"), F.coalesce("v", F.lit(0.0)).alias("fillna"))


@query("ps_11_duplicated", "PS-11", """
SELECT l_orderkey, l_linenumber, count(*) - 1 AS duplicates, min(l_partkey) AS kept FROM lineitem GROUP BY ALL""")
def duplicated(t):
    """Duplicate flags come from counts: all but the first row of a key are duplicates."""
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    counts = l.groupBy("l_orderkey", "l_linenumber").agg((F.count("*") - 1).alias("duplicates"))
    kept = one_per_key(l, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")]).drop("l_suppkey").withColumnRenamed("l_partkey", "kept")
    return counts.join(kept, ["l_orderkey", "l_linenumber"])


@query("ps_12_valid_index", "PS-12", f"""
SELECT user_id, min_by(event_id, ts) FILTER (v IS NOT NULL) AS first_valid, max_by(event_id, ts) FILTER (v IS NOT NULL) AS last_valid FROM {GAPS} GROUP BY 1""")
def valid_index(t):
    ok = F.when(~(F.col("event_id") % 4).isin(1, 2), F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(F.min_by("event_id", ok).alias("first_valid"), F.max_by("event_id", ok).alias("last_valid"))


@query("ps_13_apply", "PS-13", """
SELECT p_partkey, p_size * 2 + 1 AS mapped, upper(p_name) AS applied, round(p_retailprice / 100, 6) AS transformed FROM part""")
def apply(t):
    """Element-wise Python over Arrow batches, for functions the built-ins cannot express."""
    @F.pandas_udf("long")
    def mapped(s: pd.Series) -> pd.Series:
        return s * 2 + 1

    def batches(frames):
        for f in frames:
            yield f.assign(applied=f["p_name"].str.upper(), transformed=(f["p_retailprice"] / 100).round(6))[["p_partkey", "mapped", "applied", "transformed"]]

    return t.part.select("p_partkey", mapped("p_size").alias("mapped"), "p_name", "p_retailprice").mapInPandas(batches, "p_partkey long, mapped long, applied string, transformed double")


@query("ps_14_batch_apply", "PS-14", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_partkey, p_size + 100 AS shifted FROM part")
def batch_apply(t):
    numbered = positions(t.part.select("p_partkey", "p_size"), [], [F.col("p_partkey")], "p").withColumn("id", F.col("p") - 1)

    def batches(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "p_partkey": f["p_partkey"], "shifted": f["p_size"] + 100})

    return numbered.mapInPandas(batches, "id long, p_partkey long, shifted long")


@query("ps_15_group_aggregates", "PS-15", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS p FROM lineitem), m AS (SELECT l_suppkey, avg(abs(l_quantity - a)) AS mad FROM lineitem JOIN (SELECT l_suppkey, avg(l_quantity) AS a FROM lineitem GROUP BY 1) USING (l_suppkey) GROUP BY 1)
SELECT l_suppkey, count(*) AS n, min_by(l_orderkey, p) AS first, max_by(l_orderkey, p) AS last, min_by(l_orderkey, p) FILTER (p >= 3) AS nth, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(skewness(l_quantity), 5) AS skew, round(any_value(mad), 6) AS mad,
 round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS sem, bool_and(l_quantity > 0) AS alls, bool_or(l_quantity > 49) AS anys, count(DISTINCT l_partkey) AS nunique, quantile_cont(l_quantity, 0.5) AS median, max_by(l_orderkey, (l_extendedprice, l_orderkey)) AS idxmax, min_by(l_orderkey, (l_extendedprice, l_orderkey)) AS idxmin FROM x JOIN m USING (l_suppkey) GROUP BY 1""")
def group_aggregates(t):
    """First, last and nth by an explicit order: the ends are aggregates, the nth needs only the first rows.

    Aggregates of one shape go together, so that each leaves its task as one short row per group: numbers of fixed width, the ends, the distinct parts, and
    what needs the quantities themselves, which takes them counted. In one aggregate the distinct parts would multiply all the others."""
    l = t.lineitem.filter("l_suppkey IS NOT NULL")
    q, k, n, times = F.col("l_quantity"), F.col("l_orderkey"), F.count("*"), F.col("_times")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    numbers = l.groupBy("l_suppkey").agg(
        n.alias("n"), F.avg(q).alias("_m"), r(F.avg(q), "mean"), r(F.stddev_samp(q), "std"), r(ops.sample_skew(n, F.skewness(q)), "skew", 5), r(F.stddev_samp(q) / F.sqrt(n), "sem"), F.bool_and(q > 0).alias("alls"), F.bool_or(q > 49).alias("anys"))
    numbers = cut(numbers, "numbers")  # read twice
    ends = l.groupBy("l_suppkey").agg(F.min_by(k, order).alias("first"), F.max_by(k, order).alias("last"), F.max_by(k, F.struct("l_extendedprice", "l_orderkey")).alias("idxmax"), F.min_by(k, F.struct("l_extendedprice", "l_orderkey")).alias("idxmin"))
    unique = l.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("nunique"))
    counted = l.filter(q.isNotNull()).groupBy("l_suppkey", "l_quantity").agg(n.alias("_times"))
    spread = counted.join(numbers.select("l_suppkey", "_m"), "l_suppkey").groupBy("l_suppkey").agg(r(F.sum(F.abs(q - F.col("_m")) * times) / F.sum(times), "mad"), F.percentile(q, F.lit(0.5), times).alias("median"))
    nth = top_per_key(l, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice")], 3).filter("place = 3").select("l_suppkey", F.col("l_orderkey").alias("nth"))
    out = numbers.join(ends, "l_suppkey").join(spread, "l_suppkey", "left").join(unique, "l_suppkey").join(nth, "l_suppkey")
    return out.select("l_suppkey", "n", "first", "last", "mean", "std", "skew", "mad", "sem", "alls", "anys", "nunique", "median", "idxmax", "idxmin", "nth")


@query("ps_17_group_apply", "PS-17", """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY ALL), s AS (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 60)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round((v - avg(v) OVER p) / stddev_samp(v) OVER p, 5) AS z FROM d WHERE user_id IN (SELECT user_id FROM s) WINDOW p AS (PARTITION BY user_id)""")
def group_apply(t):
    """Groups handed to Python hold one row per day, so their size is set by the calendar; filter is a semi join."""
    def z(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["z"] = ((pdf["v"] - pdf["v"].mean()) / pdf["v"].std()).round(5)
        return pdf[["user_id", "day", "z"]]

    busy = t.events.groupBy("user_id").count().filter("count > 60").select("user_id")
    daily = t.events.join(busy, "user_id", "left_semi").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("v"))
    return daily.groupBy("user_id").applyInPandas(z, "user_id long, day string, z double")


@query("ps_18_group_values", "PS-18", """
SELECT 'nlargest' AS form, o_custkey AS k, o_orderkey AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2 UNION ALL SELECT 'nsmallest', o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 2
UNION ALL SELECT 'value_counts', o_custkey, count(*) FROM orders GROUP BY o_custkey, o_orderpriority UNION ALL SELECT 'unique', o_custkey, count(DISTINCT o_orderpriority) FROM orders GROUP BY 2""")
def group_values(t):
    o = t.orders
    big = top_per_key(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select(F.lit("nlargest").alias("form"), F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    small = top_per_key(o, ["o_custkey"], [F.asc("o_totalprice"), F.asc("o_orderkey")], 2).select(F.lit("nsmallest"), "o_custkey", "o_orderkey")
    counts = o.groupBy("o_custkey", "o_orderpriority").count().select(F.lit("value_counts"), "o_custkey", "count")
    unique = o.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n")).select(F.lit("unique"), "o_custkey", "n")
    return big.union(small).union(counts).union(unique)


@query("ps_19_rolling", "PS-19", f"""
SELECT event_id, count(v) OVER w AS n, coalesce(round(CASE WHEN count(v) OVER w >= 3 THEN sum(v) OVER w END, 4), -1) AS sum, coalesce(CASE WHEN count(v) OVER w >= 3 THEN min(v) OVER w END, -1) AS min, coalesce(CASE WHEN count(v) OVER w >= 3 THEN max(v) OVER w END, -1) AS max, coalesce(round(CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END + 1e-9, 5), -1) AS mean,
 coalesce(round(CASE WHEN count(v) OVER w >= 3 THEN stddev_samp(v) OVER w END, 4), -1) AS std, coalesce(round(CASE WHEN count(v) OVER w >= 3 THEN var_samp(v) OVER w END, 7), -1) AS var, coalesce(round(CASE WHEN count(v) OVER w >= 3 THEN quantile_cont(v, 0.5) OVER w END, 4), -1) AS q, coalesce(round(CASE WHEN count(v) OVER w >= 3 THEN skewness(v) OVER w END, 4), -1) AS skew,
 coalesce(round(CASE WHEN count(v) OVER w >= 4 THEN kurtosis(v) OVER w END, 3), -1) AS kurt FROM {GAPS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling(t):
    e = t.events.withColumn("v", F.when(~(F.col("event_id") % 4).isin(1, 2), F.col("value")))
    stats = {k: k for k in ("sum", "min", "max", "mean", "std", "var", "quantile", "skew", "kurt")}
    out = ops.rolling(e, ["user_id"], by_time(), "v", 7, {f"r_{k}": k for k in stats}, min_periods=3)
    out = ops.rolling(out, ["user_id"], by_time(), "v", 7, {"n": "count"}, min_periods=0)
    return out.select("event_id", F.col("n").cast("long").alias("n"), nn("r_sum", "sum", 4), nn("r_min", "min"), nn("r_max", "max"), nn(F.col("r_mean") + 1e-9, "mean", 5), nn("r_std", "std", 4), nn("r_var", "var", 7), nn("r_quantile", "q", 4), nn("r_skew", "skew", 4), nn("r_kurt", "kurt", 3))


@query("ps_20_expanding", "PS-20", """
SELECT event_id, count(value) OVER w AS n, round(sum(value) OVER w, 4) AS sum, min(value) OVER w AS min, max(value) OVER w AS max, round(avg(value) OVER w + 1e-9, 5) AS mean, coalesce(round(stddev_samp(value) OVER w, 4), -1) AS std, coalesce(round(var_samp(value) OVER w, 7), -1) AS var,
 CASE WHEN count(*) OVER w > 10 THEN round(skewness(value) OVER w, 4) ELSE -1 END AS skew, CASE WHEN count(*) OVER w > 10 THEN round(kurtosis(value) OVER w, 3) ELSE -1 END AS kurt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def expanding(t):
    out = ops.expanding(t.events, ["user_id"], by_time(), "value", {f"e_{k}": k for k in ("count", "sum", "min", "max", "mean", "std", "var", "skew", "kurt")})
    many = F.col("e_count") > 10
    return out.select("event_id", F.col("e_count").cast("long").alias("n"), r("e_sum", "sum", 4), F.col("e_min").alias("min"), F.col("e_max").alias("max"), r(F.col("e_mean") + 1e-9, "mean", 5), nn("e_std", "std", 4), nn("e_var", "var", 7),
                      F.when(many, F.round("e_skew", 4)).otherwise(-1.0).alias("skew"), F.when(many, F.round("e_kurt", 3)).otherwise(-1.0).alias("kurt"))


@query("ps_20_expanding_quantile", "PS-20", """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(quantile_cont(v, 0.5) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS q FROM d""")
def expanding_quantile(t):
    """Over daily totals: a running quantile keeps its whole window, so the window is bounded by the calendar."""
    d = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.percentile("v", 0.5).over(w), 4).alias("q"))


@query("ps_21_ewm", "PS-21", """
WITH d AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT a.event_id, round(sum(b.value * pow(0.75, a.p - b.p)) / sum(pow(0.75, a.p - b.p)), 5) AS ewm FROM d a JOIN d b ON a.user_id = b.user_id AND b.p <= a.p AND b.p > a.p - 150 GROUP BY 1""")
def ewm(t):
    out = ops.ewm_mean(t.events, ["user_id"], by_time(), "value", "ewm", ops.ewm_alpha(com=3))
    return out.select("event_id", r("ewm", "ewm", 5))


@query("ps_22_resample", "PS-22", """
WITH b AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bin, value FROM events),
g AS (SELECT event_type, bin, min(value) AS lo, max(value) AS hi, sum(value) AS s, avg(value) AS m, stddev_samp(value) AS sd, var_samp(value) AS vr, count(*) AS n FROM b GROUP BY ALL),
c AS (SELECT event_type, unnest(generate_series(min(bin), max(bin), INTERVAL 6 HOUR)) AS bin FROM b GROUP BY 1)
SELECT event_type, strftime(c.bin, '%Y-%m-%d %H:%M') AS bin, coalesce(lo, -1) AS lo, coalesce(hi, -1) AS hi, round(coalesce(s, 0), 4) AS s, coalesce(round(m + 1e-9, 5), -1) AS m, coalesce(round(sd, 4), -1) AS sd, coalesce(round(vr, 7), -1) AS vr, coalesce(n, 0) AS n FROM c LEFT JOIN g USING (event_type, bin)""")
def resample(t):
    out = ops.resample(t.events, ["event_type"], "ts", "value", 6 * 3600)
    return out.select("event_type", F.date_format("bin", "yyyy-MM-dd HH:mm").alias("bin"), nn("min", "lo"), nn("max", "hi"), r("sum", "s", 4), nn(F.col("mean") + 1e-9, "m", 5), nn("std", "sd", 4), nn("var", "vr", 7), "n")


@query("ps_23_series", "PS-23", """
WITH s AS (SELECT row_number() OVER (ORDER BY date_trunc('day', ts)) AS p, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY 2), l AS (SELECT *, lag(v) OVER (ORDER BY p) AS prev FROM s)
SELECT (SELECT round(corr(v, prev), 5) FROM l) AS autocorr, count(*) FILTER (v BETWEEN 40 AND 60) AS between_n, arg_max(p, v) - 1 AS argmax, arg_min(p, v) - 1 AS argmin, count(*) FILTER (v < 50) AS searchsorted, count(DISTINCT floor(v)) AS uniq, count(*) FILTER (v IS DISTINCT FROM prev) AS changed, count(*) * 2 AS repeated, (SELECT p - 1 FROM s ORDER BY v, p LIMIT 1) AS argsort0 FROM l""")
def series(t):
    """Daily means as one series (a row per calendar day)."""
    s = cut(t.events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("v")), "daily")
    s = positions(s, [], [F.col("day")], "p")
    s = framed(s, [], [F.col("day")], 1, 0, {"prev": lambda _, w: F.lag("v").over(w)})
    v, p = F.col("v"), F.col("p") - 1
    return s.agg(r(F.corr("v", "prev"), "autocorr", 5), F.count_if(v.between(40, 60)).alias("between_n"), F.max_by(p, v).alias("argmax"), F.min_by(p, v).alias("argmin"), F.count_if(v < 50).alias("searchsorted"), F.count_distinct(F.floor(v)).alias("uniq"),
                 F.count_if(~v.eqNullSafe(F.col("prev"))).alias("changed"), F.sum(F.size(F.array_repeat(v, 2))).alias("repeated"), F.min_by(p, F.struct("v", "p")).alias("argsort0"))


@query("ps_23_map_asof", "PS-23", """
WITH m AS (SELECT * FROM (VALUES ('F', 'final'), ('O', 'open')) v(k, w)) SELECT o_orderkey, coalesce(w, 'other') AS mapped FROM orders LEFT JOIN m ON k = o_orderstatus""")
def series_map(t):
    mapping = t.spark.createDataFrame([("F", "final"), ("O", "open")], "o_orderstatus string, mapped string")
    return t.orders.select("o_orderkey", "o_orderstatus").join(F.broadcast(mapping), "o_orderstatus", "left").select("o_orderkey", F.coalesce("mapped", F.lit("other")).alias("mapped"))


@query("ps_24_string_accessor", "PS-24", """
SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS capitalize, length(p_name) - length(replace(p_name, 'e', '')) AS count, instr(p_name, 'e') - 1 AS find, length(p_name) - instr(reverse(p_name), 'e') AS rfind_e, lpad(p_partkey::VARCHAR, 8, '0') AS zfill, regexp_matches(p_name, '^[A-Za-z]+$') AS isalpha, regexp_matches(p_partkey::VARCHAR, '^[0-9]+$') AS isdigit,
 p_name = lower(p_name) AS islower, repeat('*', (20 - length(p_name)) // 2) || p_name || repeat('*', 20 - length(p_name) - (20 - length(p_name)) // 2) AS center, string_split(p_name, ' ')[1] AS part0, string_split(p_brand, '#')[2] AS rpart, left(p_name, 2) || 'Z' || substr(p_name, 5) AS sliced, translate(p_name, 'aeiou', 'AEIOU') AS translated, upper(p_brand) AS swapped FROM part""")
def string_accessor(t):
    n, b = F.col("p_name"), F.col("p_brand")
    size = F.length(n)
    rfind = F.when(F.instr(F.reverse(n), "e") > 0, size - F.instr(F.reverse(n), "e")).otherwise(F.lit(-1))
    left = F.floor((20 - size) / 2).cast("int")
    fill = lambda k: F.repeat(F.lit("*"), k)
    swap = F.array_join(F.transform(F.split(b, ""), lambda c: F.when(c == F.lower(c), F.upper(c)).otherwise(F.lower(c))), "")
    return t.part.select(
        "p_partkey", F.concat(F.upper(F.substring(n, 1, 1)), F.lower(F.substr(n, F.lit(2)))).alias("capitalize"), F.regexp_count(n, F.lit("e")).cast("long").alias("count"), (F.instr(n, "e") - 1).alias("find"), F.when(F.instr(n, "e") > 0, rfind).otherwise(size).alias("rfind_e"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("zfill"), n.rlike("^[A-Za-z]+$").alias("isalpha"), F.col("p_partkey").cast("string").rlike("^[0-9]+$").alias("isdigit"), (n == F.lower(n)).alias("islower"), F.concat(fill(left), n, fill(20 - size - left)).alias("center"), F.split(n, " ")[0].alias("part0"),
        F.element_at(F.split(b, "#"), -1).alias("rpart"), F.concat(F.substring(n, 1, 2), F.lit("Z"), F.substr(n, F.lit(5))).alias("sliced"), F.translate(n, "aeiou", "AEIOU").alias("translated"), F.upper(swap).alias("swapped"))


def wrapped(text: Column, width: int, break_long: bool = True) -> Column:
    """Lines of at most ``width`` characters (array), filled word by word; null stays null, a blank text has no lines.

    Words are runs without ASCII white space; they are not cut at hyphens. A word longer than a line fills what is left of the line and goes on on the
    next ones, or with ``break_long`` off stands on a line of its own. One fold over the words, which keeps the lines so far and the open one."""
    words = F.filter(F.split(text, r"[\t-\r ]+"), lambda w: w != "")
    none = F.array().cast("array<string>")

    def step(s: Column, w: Column) -> Column:
        line, lines = s["line"], s["lines"]
        flushed = F.when(line == "", lines).otherwise(F.concat(lines, F.array(line)))
        start = F.when(line == "", line).otherwise(F.concat(line, F.lit(" ")))
        state = lambda lines, line: F.struct(lines.alias("lines"), line.alias("line"))
        fits = F.length(start) + F.length(w) <= width
        placed = F.when(fits, state(lines, F.concat(start, w))).otherwise(state(flushed, w))
        if not break_long:
            return placed
        room = F.greatest(width - F.length(start), F.lit(0))
        head = F.when(room > 0, F.concat(start, F.substring(w, F.lit(1), room))).otherwise(line)
        rest = F.when(room > 0, F.substr(w, room + 1)).otherwise(w)
        count = F.ceil(F.length(rest) / width).cast("int")
        pieces = F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(rest, (i - 1) * width + 1, F.lit(width)))
        long = state(F.concat(lines, F.array(head), F.slice(pieces, F.lit(1), count - 1)), F.element_at(pieces, -1))
        return F.when((F.length(w) > width) & ~fits, long).otherwise(placed)

    start = F.struct(none.alias("lines"), F.lit("").alias("line"))
    return F.aggregate(words, start, step, lambda s: F.when(s["line"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))))


@query("ps_24_string_wrap", "PS-24", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x09-\x0D ]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: a || CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(x) <= 60 THEN ' ' ELSE chr(10) END || x) END AS wrapped FROM w""")
def string_wrap(t):
    return t.documents.select("doc_id", F.array_join(wrapped(F.col("text"), 60, break_long=False), "\n").alias("wrapped"))


@query("ps_25_datetime_accessor", "PS-25", """
SELECT event_id, week(ts) AS week, (dayofweek(ts) + 6) % 7 AS weekday, microsecond(ts) % 1000000 AS us, day(ts) = 1 AS month_start, ts::DATE = last_day(ts) AS month_end, day(ts) = 1 AND month(ts) IN (1, 4, 7, 10) AS quarter_start, day(ts) = 1 AND month(ts) = 1 AS year_start, true AS leap, day(last_day(ts)) AS days_in_month, strftime(ts, '%Y-%m-%d') AS normalized,
 strftime(time_bucket(INTERVAL 1 HOUR, ts + INTERVAL 30 MINUTE), '%H:%M') AS rounded, strftime(date_trunc('hour', ts), '%H:%M') AS floored, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%H:%M') AS ceiled, monthname(ts) AS month_name, dayname(ts) AS day_name FROM events""")
def datetime_accessor(t):
    ts = F.col("ts")
    first = F.dayofmonth(ts) == 1
    days = F.dayofmonth(F.last_day(ts))
    hour = F.date_trunc("hour", ts)
    hm = lambda c, n: F.date_format(c, "HH:mm").alias(n)
    leap = F.dayofmonth(F.last_day(F.make_date(F.year(ts), F.lit(2), F.lit(1)))) == 29
    return t.events.select(
        "event_id", F.weekofyear(ts).alias("week"), F.weekday(ts).alias("weekday"), F.pmod(F.unix_micros(ts), F.lit(1000000)).alias("us"), first.alias("month_start"), (F.to_date(ts) == F.last_day(ts)).alias("month_end"), (first & F.month(ts).isin(1, 4, 7, 10)).alias("quarter_start"), (first & (F.month(ts) == 1)).alias("year_start"), leap.alias("leap"),
        days.alias("days_in_month"), F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd").alias("normalized"), hm(F.date_trunc("hour", ts + F.expr("INTERVAL 30 MINUTES")), "rounded"), hm(hour, "floored"), hm(F.when(hour == ts, ts).otherwise(hour + F.expr("INTERVAL 1 HOUR")), "ceiled"), F.date_format(ts, "MMMM").alias("month_name"), F.date_format(ts, "EEEE").alias("day_name"))


@query("ps_26_categories", "PS-26", """
WITH d AS (SELECT c_mktsegment AS category, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_custkey, code, CASE category WHEN 'BUILDING' THEN 'HOUSES' ELSE category END AS renamed, CASE WHEN category = 'FURNITURE' THEN -1 ELSE code END AS after_removal FROM customer JOIN d ON category = c_mktsegment""")
def categories(t):
    """The category dictionary is a small ordered table; renaming and removing edit it, not the rows."""
    d = positions(t.customer.select(F.col("c_mktsegment").alias("category")).distinct(), [], [F.col("category")], "p").withColumn("code", F.col("p") - 1)
    d = d.withColumn("renamed", F.when(F.col("category") == "BUILDING", "HOUSES").otherwise(F.col("category"))).withColumn("after_removal", F.when(F.col("category") == "FURNITURE", -1).otherwise(F.col("code")))
    return t.customer.join(d, F.col("c_mktsegment") == F.col("category")).select("c_custkey", "code", "renamed", "after_removal")


@query("ps_27_converters", "PS-27", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed, true AS bad_date, o_totalprice AS number, true AS bad_number, o_orderkey % 100 * 60 AS seconds, 3 AS days, o_orderpriority IS NULL AS isna FROM orders""")
def converters(t):
    text = F.date_format("o_orderdate", "yyyy/MM/dd")
    delta = F.make_dt_interval(mins=(F.col("o_orderkey") % 100).cast("int"))
    days = F.size(F.sequence(F.to_date("o_orderdate"), F.date_add("o_orderdate", 2)))
    return t.orders.select("o_orderkey", F.date_format(F.try_to_timestamp(text, F.lit("yyyy/MM/dd")), "yyyy-MM-dd").alias("parsed"), F.try_to_timestamp(F.col("o_orderstatus"), F.lit("yyyy")).isNull().alias("bad_date"),
                           F.col("o_totalprice").cast("string").try_cast("double").alias("number"), F.col("o_orderpriority").try_cast("double").isNull().alias("bad_number"),
                           (F.unix_seconds(F.lit(0).cast("timestamp") + delta)).alias("seconds"), days.alias("days"), F.isnull("o_orderpriority").alias("isna"))


@query("ps_28_read_write", "PS-28 PS-29", "SELECT 'csv' AS format, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier UNION ALL SELECT 'json', count(*), round(sum(s_acctbal), 2) FROM supplier UNION ALL SELECT 'parquet', count(*), round(sum(s_acctbal), 2) FROM supplier UNION ALL SELECT 'orc', count(*), round(sum(s_acctbal), 2) FROM supplier")
def read_write(t):
    out = None
    for fmt in ("csv", "json", "parquet", "orc"):
        path = scratch(t.spark, f"frame_{fmt}")
        t.supplier.write.format(fmt).save(path)
        part = t.spark.read.schema(t.supplier.schema).format(fmt).load(path).agg(F.lit(fmt).alias("format"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
        out = part if out is None else out.union(part)
    return out


@query("ps_30_correlation", "PS-30", """
WITH a AS (SELECT l_quantity AS x, l_tax AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS ry FROM lineitem),
g AS (SELECT x, y, count(*) AS n FROM a GROUP BY ALL),
p AS (SELECT sum(CASE WHEN (c.x - d.x) * (c.y - d.y) > 0 THEN c.n * d.n END) / 2 AS con, sum(CASE WHEN (c.x - d.x) * (c.y - d.y) < 0 THEN c.n * d.n END) / 2 AS dis FROM g c CROSS JOIN g d),
tx AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM g GROUP BY x)), ty AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM g GROUP BY y)), al AS (SELECT sum(n) * (sum(n) - 1) / 2 AS v FROM g)
SELECT round((SELECT corr(x, y) FROM a), 6) AS pearson, round((SELECT corr(rx, ry) FROM a), 6) AS spearman, round((con - dis) / sqrt((al.v - tx.v) * (al.v - ty.v)), 6) AS kendall FROM p, tx, ty, al""")
def correlation(t):
    """Pearson, Spearman and Kendall (tau-b); Kendall counts inversions instead of forming pairs."""
    l = t.lineitem.select("l_quantity", "l_tax", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("tie"))
    pearson = l.agg(r(F.corr("l_quantity", "l_tax"), "pearson"))
    s = ops.spearman(l, [], "l_quantity", "l_tax", "tie").select(r("spearman", "spearman"))
    k = ops.kendall(l, "l_quantity", "l_tax").select(r("kendall", "kendall"))
    return pearson.crossJoin(s).crossJoin(k)  # one row each


@query("ps_31_sql_over_frames", "PS-31 SRC-25", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY 1")
def sql_over_frames(t):
    return t.spark.sql("SELECT c_mktsegment, count(*) AS n FROM {c} WHERE c_acctbal > :low GROUP BY c_mktsegment", args={"low": 1000}, c=t.customer)
