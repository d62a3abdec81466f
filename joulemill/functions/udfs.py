"""Python functions where they are the feature: scalar, vectorised, grouped, cogrouped, map and table functions.

Grouped and cogrouped functions receive groups whose size is bounded by the data model (a row per day or
per year), never raw rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, functions as F

from joulemill.registry import query


@query("udm_01_scalar", "UDM-01 UDM-10 UDF-0", """
SELECT p_partkey, split_part(p_brand, '#', 2)::BIGINT AS number, upper(p_name) AS shouted, 'brand#' || split_part(p_brand, '#', 2) AS cleaned, abs(p_size - 25)::BIGINT AS reflected FROM part""")
def scalar(t):
    """A pickled row function, its Arrow form, one called from SQL text, and built-ins called by name."""
    number = F.udf(lambda s: int(s.split("#")[1]), "long")
    shouted = F.udf(lambda s: s.upper(), "string", useArrow=True)
    t.spark.udf.register("joulemill_clean", lambda s: s.lower(), "string")
    size = F.call_function("abs", F.col("p_size") - 25)
    mirrored = F.reflect(F.lit("java.lang.Math"), F.lit("abs"), F.col("p_size") - 25)
    same = F.java_method(F.lit("java.lang.Math"), F.lit("abs"), F.col("p_size") - 25)
    return t.part.select("p_partkey", number("p_brand").alias("number"), shouted("p_name").alias("shouted"), F.call_udf("joulemill_clean", "p_brand").alias("cleaned"),
                         F.when((mirrored == same) & (mirrored.cast("int") == size), size.cast("long")).alias("reflected"))


@query("udm_03_vectorised", "UDM-03 WL-25", """
SELECT p_partkey, round(p_retailprice * (1 - 0.01 * least(p_size, 30)), 6) AS rebated, split_part(p_brand, '#', 2)::BIGINT AS brand,
 round(p_retailprice / greatest(p_size, 1), 6) AS per_unit, split_part(p_name, ' ', 1) AS first, len(string_split(p_name, ' '))::BIGINT AS words FROM part""")
def vectorised(t):
    """Series to Series, iterator of series, iterator of several series, and series to frame, each for a figure of the price list."""
    import re

    @F.pandas_udf("double")
    def rebated(price: pd.Series, size: pd.Series) -> pd.Series:
        return (price * (1 - 0.01 * size.clip(upper=30))).round(6)

    @F.pandas_udf("long")
    def brand(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number = re.compile(r"#(\d+)")  # compiled once for all batches of a task
        for names in batches:
            yield names.str.extract(number, expand=False).astype("int64")

    @F.pandas_udf("double")
    def per_unit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for price, size in batches:
            yield (price / size.where(size > 0, 1)).round(6)

    @F.pandas_udf("first string, words long")
    def parted(names: pd.Series) -> pd.DataFrame:
        parts = names.str.split(" ")
        return pd.DataFrame({"first": parts.str[0], "words": parts.str.len()})

    x = t.part.select("p_partkey", rebated("p_retailprice", "p_size").alias("rebated"), brand("p_brand").alias("brand"), per_unit("p_retailprice", "p_size").alias("per_unit"), parted("p_name").alias("n"))
    return x.select("p_partkey", "rebated", "brand", "per_unit", "n.first", "n.words")


@query("udm_03_series_to_scalar", "UDM-03 UDM-10", """
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY ALL)
SELECT o_custkey, round(max(s) - min(s), 2) AS spread FROM y GROUP BY 1""")
def series_to_scalar(t):
    """A Python aggregate over yearly sums: a handful of values per customer reach Python."""
    @F.pandas_udf("double")
    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    t.spark.udf.register("joulemill_spread", spread)
    y = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s"))
    y.createOrReplaceTempView("joulemill_years")
    return t.spark.sql("SELECT o_custkey, round(joulemill_spread(s), 2) AS spread FROM joulemill_years GROUP BY o_custkey")


@query("udm_04_grouped_map", "UDM-04 RD-01", """
WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 6) AS v FROM events GROUP BY ALL)
SELECT user_id, day, round(v / max(v) OVER (PARTITION BY user_id), 5) AS of_best, rank() OVER (PARTITION BY user_id ORDER BY v DESC) - 1 AS better_days FROM d""")
def grouped_map(t):
    """Each user's days against the best one; a group is a row per day."""
    def compare(days: pd.DataFrame) -> pd.DataFrame:
        best_first = days["v"].rank(method="min", ascending=False).astype("int64")
        return pd.DataFrame({"user_id": days["user_id"], "day": days["day"], "of_best": (days["v"] / days["v"].max()).round(5), "better_days": best_first - 1})

    d = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))
    return d.groupBy("user_id").applyInPandas(compare, "user_id long, day string, of_best double, better_days long")


@query("udm_05_cogrouped_map", "UDM-05 UDM-06", """
WITH p AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS bought FROM events WHERE event_type = 'purchase' GROUP BY ALL), v AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS seen FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.user_id, strftime(p.day, '%Y-%m-%d') AS day, round(bought, 4) AS bought, coalesce(round(seen, 4), -1) AS seen FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.day >= v.day""")
def cogrouped_map(t):
    """As-of merge of two daily series per user in Python; the raw-row form is the window-based join."""
    def merge(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame({"user_id": [], "day": [], "bought": [], "seen": []})
        m = pd.merge_asof(a.sort_values("day"), b.sort_values("day")[["day", "seen"]], on="day")
        return m.assign(day=m["day"].dt.strftime("%Y-%m-%d"), seen=m["seen"].round(4).fillna(-1.0), bought=m["bought"].round(4))[["user_id", "day", "bought", "seen"]]

    def daily(kind, name):
        return t.events.filter(F.col("event_type") == kind).groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias(name))

    return daily("purchase", "bought").groupBy("user_id").cogroup(daily("view", "seen").groupBy("user_id")).applyInPandas(merge, "user_id long, day string, bought double, seen double")


@query("udm_07_map_batches", "UDM-07 UDM-08", """
SELECT c_custkey, c_acctbal * 2 AS twice, upper(c_mktsegment) AS segment FROM customer WHERE c_acctbal > 0""")
def map_batches(t):
    def pandas_step(frames):
        for f in frames:
            yield f[f["c_acctbal"] > 0]

    def arrow_step(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2.0), pc.utf8_upper(b.column(2))], ["c_custkey", "twice", "segment"])

    kept = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment").mapInPandas(pandas_step, "c_custkey long, c_acctbal double, c_mktsegment string")
    return kept.mapInArrow(arrow_step, "c_custkey long, twice double, segment string")


@query("udm_02_table_functions", "UDM-02 UDM-11 WL-24", """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), shouted AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM w),
b AS (SELECT user_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS held FROM events WHERE event_type = 'purchase')
SELECT 'longest' AS f, count(*) AS n, sum(place)::BIGINT AS total FROM (SELECT doc_id, min(place) AS place FROM shouted WHERE length(word) >= 12 GROUP BY 1)
UNION ALL SELECT 'months', count(*), sum(month(m))::BIGINT FROM (SELECT unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + INTERVAL 75 DAY), INTERVAL 1 MONTH)) AS m FROM orders)
UNION ALL SELECT 'milestones', count(*), count(DISTINCT user_id) FROM b WHERE floor(held / 500) > floor((held - value) / 500)""")
def table_functions(t):
    """Table functions in SQL: two lateral ones over a row each, and a running one over a partitioned and ordered table argument.

    ``jm_first_long`` finds the first word of a length and its place, ``jm_months`` lists the months that an order is open in, and
    ``jm_milestones`` emits a row whenever a user's running spending passes a multiple of a step; it holds one number per user."""

    @F.udtf(returnType="word string, place int")
    class FirstLong:
        def eval(self, text: str, length: int):
            hit = next(((w, i) for i, w in enumerate(text.split(" "), 1) if len(w) >= length), None)
            if hit:
                yield hit

    @F.udtf(returnType="month int")
    class Months:
        def eval(self, year: int, month: int, last_year: int, last_month: int):
            for k in range(12 * year + month, 12 * last_year + last_month + 1):
                yield ((k - 1) % 12 + 1,)

    @F.udtf(returnType="user_id long, reached double")
    class Milestones:
        def __init__(self):
            self.held = 0.0

        def eval(self, row: Row):
            before, self.held = self.held // 500, self.held + row["value"]
            if self.held // 500 > before:
                yield row["user_id"], self.held

    spark = t.views("documents", "orders", "events")
    for name, cls in (("jm_first_long", FirstLong), ("jm_months", Months), ("jm_milestones", Milestones)):
        spark.udtf.register(name, cls)
    return spark.sql("""
        SELECT 'longest' AS f, count(*) AS n, sum(place) AS total FROM documents, LATERAL jm_first_long(text, 12)
        UNION ALL SELECT 'months', count(*), sum(month) FROM (SELECT o_orderdate AS a, o_orderdate + INTERVAL 75 DAYS AS b FROM orders), LATERAL jm_months(year(a), month(a), year(b), month(b))
        UNION ALL SELECT 'milestones', count(*), count(DISTINCT user_id) FROM jm_milestones(TABLE(SELECT user_id, value, ts, event_id FROM events WHERE event_type = 'purchase') PARTITION BY user_id ORDER BY (ts, event_id))""")
