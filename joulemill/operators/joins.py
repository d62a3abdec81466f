"""Join operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from joulemill.operators.temporal import asof_join, points_in_spans, salted_join
from joulemill.registry import query
from joulemill.storage import checked_broadcast, cut


@query("jn_01_inner", "JN-01 JNM-01", """
SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def inner(t):
    o, c = t.orders, t.customer
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


OUTER_SQL = "SELECT '{0}' AS how, count(*) AS n, count(d.doc_id) AS with_doc, count(l.doc_id) AS with_label FROM documents d {0} JOIN labels l ON d.doc_id = l.doc_id"


@query("jn_02_outer", "JN-02", " UNION ALL ".join(OUTER_SQL.format(h) for h in ("left", "right", "full")))
def outer(t):
    d = t.documents.select("doc_id")
    l = t.labels.select(F.col("doc_id").alias("label_id"))
    out = None
    for how in ("left", "right", "full"):
        part = d.join(l, d.doc_id == l.label_id, how).agg(F.lit(how).alias("how"), F.count("*").alias("n"), F.count("doc_id").alias("with_doc"), F.count("label_id").alias("with_label"))
        out = part if out is None else out.union(part)
    return out


@query("jn_03_left_semi", "JN-03", """
SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def left_semi(t):
    o = t.orders.filter("o_totalprice > 400000")
    c = t.customer
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query("jn_04_left_anti", "JN-04", """
SELECT c_custkey, 'not exists' AS form FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
UNION ALL SELECT c_custkey, 'not in' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def left_anti(t):
    c = t.customer
    o = t.orders.filter("o_totalprice > 400000")
    anti = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", F.lit("not exists").alias("form"))
    # NOT IN is false or unknown as soon as the list holds a null: one aggregate tells, and the rest is a plain anti join that
    # need not broadcast the list.
    listed = t.orders.filter("o_totalprice > 300000").select("o_custkey")
    facts = listed.agg(F.count("*").alias("n"), F.count("o_custkey").alias("known"))
    free = c.crossJoin(F.broadcast(facts)).filter("n = 0 OR (n = known AND c_custkey IS NOT NULL)")
    not_in = free.join(listed, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("not in").alias("form"))
    return anti.union(not_in)


@query("jn_05_cross", "JN-05 JNM-02", """
SELECT o_orderpriority, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 8) AS share FROM orders GROUP BY 1""")
def cross(t):
    """The product is used where it cannot grow: groups times a one-row total."""
    groups = t.orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    total = t.orders.agg(F.sum("o_totalprice").alias("total"))
    return groups.crossJoin(total).select("o_orderpriority", F.round(F.col("s") / F.col("total"), 8).alias("share"))


@query("jn_06_using", "JN-06", """
SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)""")
def using(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), on=["doc_id"])


@query("jn_07_range", "JN-07", """
WITH p AS (SELECT date_trunc('quarter', o_orderdate) AS q, epoch(min(o_orderdate))::BIGINT AS lo, epoch(max(o_orderdate))::BIGINT AS hi FROM orders GROUP BY 1)
SELECT strftime(q, '%Y-%m-%d') AS q, count(*) AS lines, round(sum(l_extendedprice), 2) AS price
FROM lineitem JOIN p ON epoch(l_shipdate)::BIGINT BETWEEN lo AND hi GROUP BY 1""")
def range_join(t):
    """Band join without a natural key: lines against order quarters of varying length."""
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    spans = cut(t.orders.groupBy(F.date_trunc("quarter", "o_orderdate").alias("q")).agg(F.min(at).alias("lo"), F.max(at).alias("hi")), "quarters")
    lines = t.lineitem.select("l_extendedprice", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("at"))
    return points_in_spans(lines, spans, "at", "lo", "hi", base=86400).groupBy(F.date_format("q", "yyyy-MM-dd").alias("q")).agg(
        F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("jn_08_interval", "JN-08", """
WITH j AS (SELECT user_id AS job_user, event_type AS model, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events GROUP BY ALL)
SELECT model, count(*) AS samples, count(DISTINCT job_user) AS jobs FROM events e JOIN j ON j.job_user = e.user_id
 AND epoch_us(e.ts) BETWEEN lo AND hi GROUP BY 1""")
def interval(t):
    """Executor samples inside the span of the jobs that share their user."""
    at = F.unix_micros("ts")
    jobs = cut(t.events.groupBy("user_id", F.col("event_type").alias("model")).agg(F.min(at).alias("lo"), F.max(at).alias("hi")), "spans")
    points = t.events.select("user_id", at.alias("at"))
    hits = points_in_spans(points, jobs, "at", "lo", "hi", ["user_id"], base=3_600_000_000)
    return hits.groupBy("model").agg(F.count("*").alias("samples"), F.count_distinct("user_id").alias("jobs"))


ASOF_SIDES = """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts AS rts, value FROM events WHERE event_type = 'view')
"""


def _asof(t, **kw):
    e = t.events
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", "ts", "value")
    out = asof_join(left, right, "ts", ["user_id"], ["value"], **kw)
    return out.select("event_id", F.coalesce(F.col("value"), F.lit(-1.0)).alias("value"),
                      F.coalesce(F.date_format("matched_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("none")).alias("matched"))


PICKED = " SELECT event_id, coalesce(value, -1) AS value, coalesce(strftime(rts, '%Y-%m-%d %H:%M:%S.%f'), 'none') AS matched "


@query("jn_09_asof_backward", "JN-09", ASOF_SIDES + PICKED + "FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.rts")
def asof_backward(t):
    return _asof(t)


@query("jn_09_asof_forward", "JN-09", ASOF_SIDES + PICKED + "FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.rts")
def asof_forward(t):
    return _asof(t, direction="forward")


@query("jn_09_asof_nearest", "JN-09 PS-04", ASOF_SIDES + """
, c AS (SELECT l.event_id, r.value, r.rts, abs(epoch_us(l.ts) - epoch_us(r.rts)) AS gap FROM l JOIN r USING (user_id)
  WHERE l.ts <> r.rts QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY gap, r.rts) = 1)
SELECT event_id, coalesce(CASE WHEN gap <= 7200000000 THEN value END, -1) AS value,
 coalesce(CASE WHEN gap <= 7200000000 THEN strftime(rts, '%Y-%m-%d %H:%M:%S.%f') END, 'none') AS matched FROM l LEFT JOIN c USING (event_id)""")
def asof_nearest(t):
    return _asof(t, direction="nearest", tolerance_s=7200, allow_exact_matches=False)


@query("jn_10_hints", "JN-10 JNM-03 JN-H", """
SELECT strategy, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
CROSS JOIN (VALUES ('broadcast'), ('merge'), ('shuffle_hash'), ('checked')) s(strategy) WHERE c_acctbal > 0 GROUP BY ALL""")
def hints(t):
    """The same join under each strategy hint; the broadcasts sit behind a size check."""
    c = t.customer.filter("c_acctbal > 0").select("c_custkey")
    o = t.orders.select("o_custkey", "o_orderpriority")
    small = checked_broadcast(c)
    hinted = c.hint("broadcast") if small is not c else c
    sides = {"broadcast": hinted, "merge": c.hint("merge"), "shuffle_hash": c.hint("shuffle_hash"), "checked": small}
    out = None
    for name, side in sides.items():
        part = o.join(side, o.o_custkey == side.c_custkey).groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("jn_11_null_safe", "JN-11", """
WITH d AS (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (SELECT quality AS q, count(*) AS labelled FROM labels GROUP BY 1 UNION ALL SELECT NULL, 0)
SELECT coalesce(d.q, -1) AS q, count(*) AS n, min(labelled)::BIGINT AS labelled FROM d JOIN k ON d.q IS NOT DISTINCT FROM k.q GROUP BY 1""")
def null_safe(t):
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.col("quality").alias("q"))
    k = t.labels.groupBy(F.col("quality").alias("kq")).agg(F.count("*").alias("labelled"))
    k = k.union(t.labels.agg(F.lit(None).cast("int").alias("kq"), F.lit(0).cast("long").alias("labelled")))
    return d.join(k, d.q.eqNullSafe(k.kq)).groupBy(F.coalesce("q", F.lit(-1)).alias("q")).agg(F.count("*").alias("n"), F.min("labelled").alias("labelled"))


@query("jn_12_self", "JN-12", """
WITH d AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS s FROM orders GROUP BY ALL)
SELECT a.o_custkey, strftime(a.m, '%Y-%m') AS m, round(a.s - b.s, 2) AS growth FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND a.m = b.m + INTERVAL 1 MONTH""")
def self_join(t):
    """Each customer month against the one before: one match per row, so the self join cannot multiply."""
    d = t.orders.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("s"))
    a, b = d.alias("a"), d.alias("b")
    next_month = F.date_trunc("month", F.col("b.m") + F.expr("INTERVAL 1 MONTH"))
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.m") == next_month)).select(
        "a.o_custkey", F.date_format("a.m", "yyyy-MM").alias("m"), F.round(F.col("a.s") - F.col("b.s"), 2).alias("growth"))


@query("jn_13_lateral", "JN-13", """
SELECT p_partkey, word, count(*) OVER (PARTITION BY word) AS uses FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)""")
def lateral(t):
    t.views("part")
    words = t.spark.sql("SELECT p_partkey, w.word FROM part, LATERAL explode(split(p_name, ' ')) AS w(word)")
    uses = words.groupBy("word").agg(F.count("*").alias("uses"))
    return words.join(uses, "word").select("p_partkey", "word", "uses")


@query("jn_14_skewed", "JN-14", """
WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS k, value FROM events),
u AS (SELECT user_id AS k, count(*) AS weight FROM events GROUP BY 1)
SELECT k, count(*) AS n, round(sum(value * weight), 4) AS weighted FROM e JOIN u USING (k) GROUP BY 1""")
def skewed(t):
    """A third of the rows share one key; hot keys are split and only their partners copied."""
    e = t.events.select(F.when(F.col("event_id") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("user_id")).alias("k"), "value", "event_id")
    u = t.events.groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("weight"))
    rows = e.count()
    joined = salted_join(e, u, "k", hot_rows=max(100, rows // 50))
    return joined.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("weight")), 4).alias("weighted"))


@query("jn_15_cogroup", "JN-15 RD-06", """
WITH o AS (SELECT o_custkey AS k, count(*) AS orders, sum(o_totalprice) AS spent, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS k, count(*) AS customers FROM customer GROUP BY 1)
SELECT k, coalesce(orders, 0) AS orders, round(coalesce(spent, 0), 2) AS spent, coalesce(priorities, '') AS priorities, coalesce(customers, 0) AS customers FROM o FULL JOIN c USING (k)""")
def cogroup(t):
    """Both sides are reduced per key before they meet, so a hot key never arrives as one list of rows."""
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"), F.sort_array(F.collect_set("o_orderpriority")).alias("p"))
    c = t.customer.groupBy(F.col("c_custkey").alias("k")).agg(F.count("*").alias("customers"))
    return o.join(c, "k", "full").select(
        "k", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"),
        F.coalesce(F.array_join("p", ","), F.lit("")).alias("priorities"), F.coalesce("customers", F.lit(0).cast("long")).alias("customers"))
