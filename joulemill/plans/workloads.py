"""Workload programs over the test tables: text, logs, graphs, iterative numerics, files and samples."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from joulemill.operators.exact import exact_sum
from joulemill.operators.ordered import positions
from joulemill.operators.temporal import salted_totals
from joulemill.plans import graphs
from joulemill.registry import query
from joulemill.storage import checked_broadcast, cut, scratch


def words(df, text="text"):
    return df.select(F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")


WORDS = r"(SELECT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents)"


@query("wl_01_word_count", "WL-01 RD-03", f"SELECT word, count(*) AS n FROM {WORDS} WHERE word <> '' GROUP BY 1")
def word_count(t):
    return words(t.documents).groupBy("word").agg(F.count("*").alias("n"))


@query("wl_02_total_sort", "WL-02 RD-07", "SELECT l_partkey AS k, l_orderkey, row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_extendedprice) AS place FROM lineitem")
def total_sort(t):
    l = t.lineitem.select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return positions(l, [], [F.col(c) for c in l.columns], "place").select("k", "l_orderkey", "place")


LOG_LINE = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+)$'


@query("wl_04_log_query", "WL-04", r"""
WITH l AS (SELECT e.*, p.url FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))
SELECT CASE WHEN event_type IN ('error', 'signup') THEN 'none' ELSE '10.0.0.' || (user_id % 200) END AS ip, CASE WHEN event_type IN ('error', 'signup') THEN 'none' ELSE 'u' || user_id END AS usr,
 CASE WHEN event_type IN ('error', 'signup') THEN 'none' ELSE 'GET ' || url END AS request, count(*) AS hits, sum(CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 0 ELSE floor(value)::BIGINT END)::BIGINT AS bytes FROM l GROUP BY ALL""")
def log_query(t):
    """Access lines are parsed by one pattern; unparsed lines (and user "-") fall under null keys."""
    n = t.pages.count()
    lines = t.events.withColumn("page_id", F.col("event_id") % n).join(t.pages.select("page_id", "url"), "page_id").select(
        F.when(F.col("event_type") == "error", F.lit("broken line")).otherwise(F.format_string(
            '10.0.0.%d - %s [01/Jan/2024] "GET %s" 200 %d', F.col("user_id") % 200, F.when(F.col("event_type") == "signup", F.lit("-")).otherwise(F.concat(F.lit("u"), "user_id")),
            F.col("url"), F.floor("value"))).alias("line"))
    part = lambda i: F.regexp_extract("line", LOG_LINE, i)
    parsed = lines.select(part(1).alias("ip"), part(3).alias("usr"), part(5).alias("request"), F.coalesce(part(7).try_cast("long"), F.lit(0)).alias("bytes"))
    known = (F.col("ip") != "") & (F.col("usr") != "-")
    none = F.lit("none")
    keyed = parsed.select(*[F.when(known, F.col(c)).otherwise(none).alias(c) for c in ("ip", "usr", "request")], F.when(known, F.col("bytes")).otherwise(0).alias("bytes"))
    return keyed.groupBy("ip", "usr", "request").agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"))


@query("wl_05_skewed_group_by", "WL-05", """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS k, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1""")
def skewed_group_by(t):
    l = t.lineitem.select(F.when(F.col("l_orderkey") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("l_suppkey")).alias("k"), F.col("l_quantity").alias("qty"), "l_orderkey")
    return salted_totals(l, ["k"], ["qty"])


@query("wl_06_write_read_compare", "WL-06 SRC-06 SRC-17", f"SELECT word, count(*) AS before, count(*) AS after FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1")
def write_read_compare(t):
    path = scratch(t.spark, "text")
    t.conversations.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(path)
    before = words(t.conversations).groupBy("word").agg(F.count("*").alias("before"))
    after = words(t.spark.read.text(path), "value").groupBy("word").agg(F.count("*").alias("after"))
    return before.join(after, "word", "full")


@query("wl_07_small_table_everywhere", "WL-07", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def small_table(t):
    return t.customer.join(checked_broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


TREE = "(SELECT DISTINCT o_orderkey AS src, o_orderkey // 8 AS dst FROM orders WHERE o_orderkey <> o_orderkey // 8)"


@query("wl_08_transitive_closure", "WL-08", f"""
WITH RECURSIVE e AS {TREE}, tc(src, dst) AS (SELECT src, dst FROM e UNION SELECT tc.src, e.dst FROM tc JOIN e ON tc.dst = e.src) SELECT src, dst FROM tc""")
def transitive_closure(t):
    """Closure of a hierarchy over the orders (parent = key / 8): its size grows with the rows times their depth."""
    k = F.col("o_orderkey")
    edges = t.orders.select(k.alias("src"), F.floor(k / 8).alias("dst")).filter("src <> dst")
    return graphs.transitive_closure(edges)


def order_graph(t):
    """Customer graph with one edge per order: o_custkey -> o_orderkey * 7 mod customers."""
    n = t.customer.count()
    return t.orders.select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_orderkey") * 7, F.lit(n)).alias("dst")).filter("src <> dst")


GRAPH = """g AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % (SELECT count(*) FROM customer) AS dst FROM orders WHERE o_custkey <> (o_orderkey * 7) % (SELECT count(*) FROM customer)),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g)"""
RANKS = f"""WITH {GRAPH}, l AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o FROM g), r0 AS (SELECT DISTINCT src AS id, 1.0::DOUBLE AS rank FROM g),
r1 AS (SELECT dst AS id, 0.15 + 0.85 * sum(rank / o) AS rank FROM l JOIN r0 ON id = src GROUP BY 1), r2 AS (SELECT dst AS id, 0.15 + 0.85 * sum(rank / o) AS rank FROM l JOIN r1 ON id = src GROUP BY 1),
r3 AS (SELECT dst AS id, 0.15 + 0.85 * sum(rank / o) AS rank FROM l JOIN r2 ON id = src GROUP BY 1), r4 AS (SELECT dst AS id, 0.15 + 0.85 * sum(rank / o) AS rank FROM l JOIN r3 ON id = src GROUP BY 1)"""


@query("wl_09_pagerank", "WL-09", RANKS + " SELECT id, round(rank, 6) AS rank FROM r4")
def pagerank(t):
    return graphs.pagerank(order_graph(t), rounds=4).select("id", F.round("rank", 6).alias("rank"))


@query("wl_10_pagerank_tolerance", "WL-10")
def pagerank_tolerance(t):
    """Until every residual is at or below 1e-4; a test checks the equation of every vertex."""
    return graphs.pagerank_to_tolerance(order_graph(t), 1e-4).select("id", F.round("rank", 4).alias("rank"))


@query("wl_11_connected_components", "WL-11", """
WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 4 * 4 AS b FROM part), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(id, label) AS (SELECT a, a FROM two UNION SELECT c.id, two.b FROM c JOIN two ON c.label = two.a)
SELECT id, min(label) AS component FROM c GROUP BY 1""")
def connected_components(t):
    k = F.col("p_partkey")
    return graphs.connected_components(t.part.select(k.alias("src"), (F.floor(k / 4) * 4).alias("dst")))


@query("wl_11_order_components", "WL-11", f"""
WITH RECURSIVE {GRAPH}, two AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), c(id, label) AS (SELECT a, a FROM two UNION SELECT two.b, c.label FROM c JOIN two ON c.id = two.a)
SELECT component, count(*) AS members FROM (SELECT id, min(label) AS component FROM c GROUP BY 1) GROUP BY 1""")
def order_components(t):
    return graphs.connected_components(order_graph(t)).groupBy("component").agg(F.count("*").alias("members"))


@query("wl_12_triangles", "WL-12", f"""
WITH {GRAPH}, t AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM u p JOIN u q ON p.b = q.a JOIN u r ON r.a = p.a AND r.b = q.b)
SELECT id, count(*) AS triangles FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY 1""")
def triangle_counts(t):
    return graphs.triangles(order_graph(t))


@query("wl_13_shortest_paths", "WL-13", f"""
WITH RECURSIVE {GRAPH}, e AS (SELECT src, dst, (src + dst) % 5 + 1 AS w FROM g), s(id, dist) AS (SELECT (SELECT min(src) FROM g), 0 UNION SELECT e.dst, s.dist + e.w FROM s JOIN e ON e.src = s.id WHERE s.dist + e.w <= 24)
SELECT id, min(dist)::DOUBLE AS dist FROM s GROUP BY 1""")
def shortest_paths(t):
    g = order_graph(t).distinct().withColumn("w", ((F.col("src") + F.col("dst")) % 5 + 1).cast("double"))
    g = cut(g, "weighted")
    return graphs.shortest_paths(g, g.agg(F.min("src")).first()[0])


@query("wl_14_older_followers", "WL-14", f"""
WITH {GRAPH} SELECT dst AS id, count(*) AS followers, round(avg(c_acctbal) + 1e-9, 4) AS mean FROM g JOIN customer ON c_custkey = src WHERE src > dst GROUP BY 1""")
def older_followers(t):
    """Messages along the edges from higher to lower vertices, combined per receiver."""
    g = order_graph(t).distinct().filter("src > dst")
    return g.join(t.customer.select(F.col("c_custkey").alias("src"), "c_acctbal"), "src").groupBy(F.col("dst").alias("id")).agg(
        F.count("*").alias("followers"), F.round(F.avg("c_acctbal") + 1e-9, 4).alias("mean"))


@query("wl_15_property_graph", "WL-15", f"""
WITH good AS (SELECT c_custkey AS id, c_name FROM customer WHERE c_acctbal > 0), g0 AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % (SELECT count(*) FROM customer) AS dst FROM orders), g AS (SELECT * FROM g0 WHERE src <> dst AND src IN (SELECT id FROM good) AND dst IN (SELECT id FROM good)),
l AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o FROM g), r0 AS (SELECT DISTINCT src AS id, 1.0::DOUBLE AS rank FROM g), r1 AS (SELECT dst AS id, 0.15 + 0.85 * sum(rank / o) AS rank FROM l JOIN r0 ON id = src GROUP BY 1),
r2 AS (SELECT dst AS id, 0.15 + 0.85 * sum(rank / o) AS rank FROM l JOIN r1 ON id = src GROUP BY 1), r3 AS (SELECT dst AS id, 0.15 + 0.85 * sum(rank / o) AS rank FROM l JOIN r2 ON id = src GROUP BY 1)
SELECT c_name, round(rank, 6) AS rank FROM r3 JOIN good USING (id) ORDER BY rank DESC, c_name LIMIT 5""")
def property_graph(t):
    """Attach attributes by an outer join, keep edges whose both ends have them, rank, report the top five."""
    people = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("c_name"))
    full = people.filter(F.col("c_name").isNotNull())
    ends = full.select("id")
    g = order_graph(t).join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ranks = graphs.pagerank(g, rounds=3)
    return ranks.join(full, "id").select("c_name", F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "c_name").limit(5)


@query("wl_16_degree_histogram", "WL-16", f"""
WITH {GRAPH}, d AS (SELECT v, count(*) AS degree FROM (SELECT a AS v FROM u UNION ALL SELECT b FROM u) GROUP BY 1)
SELECT degree, count(*) AS vertices, (SELECT count(*) FROM d) AS all_vertices, (SELECT count(*) FROM u) AS all_edges FROM d GROUP BY 1""")
def degree_histogram(t):
    u = cut(order_graph(t).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "undirected")
    d = cut(u.select(F.col("a").alias("v")).union(u.select("b")).groupBy("v").agg(F.count("*").alias("degree")), "degrees")
    sizes = d.agg(F.count("*").alias("all_vertices")).crossJoin(u.agg(F.count("*").alias("all_edges")))
    return d.groupBy("degree").agg(F.count("*").alias("vertices")).crossJoin(F.broadcast(sizes))


EDGE_BYTES = 16 << 20  # of the points near the border of two centres that the driver goes on with between two passes, at most


def kmeans(points, k, tolerance=1e-3, most=None):
    """Centres of plain k-means, from the k points with the smallest ids, until they move by no more than ``tolerance`` in all (squared). Large tables of
    scattered points take thousands of rounds, so there is no limit unless ``most`` is given; centres that come back to a former place, or leave the
    numbers, are an error, and so are centres that still move after ``most`` rounds.

    Points are written once, as blocks of numbers. A pass over them is one stage: a partition returns a sum per centre, and these are added exactly, and the
    points with the smallest margins, the difference of the distances to the second nearest and the nearest centre. No other point can get another centre
    while no two centres have moved by more in all than the smallest margin left out (triangle inequality); so long, the driver finishes rounds with the
    returned points alone. Only when that would save nothing are they not returned."""
    first = [r["v"] for r in points.orderBy("id").limit(k).select(F.col("v").cast("array<double>").alias("v")).collect()]
    centres = np.array(first, dtype=float)
    if not len(centres):
        return centres

    def pack(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32()), "x": pa.array([packed(rows_of(b.column(0)))], pa.binary())})

    table = cut(points.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(pack, "n int, x binary"), "points")
    share = min(1.0, EDGE_BYTES / (8 * centres.shape[1] * (table.agg(F.sum("n")).first()[0] or 1)))
    drift, least, rounds, seen = np.inf, np.inf if share == 1 else 0.0, 0, set()
    while True:
        def visit(batches, c=centres, keep=2 * drift < least or share == 1):
            yield edges((unpacked(x, n, c.shape[1]) for b in batches for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), c, share, keep)

        found = table.mapInArrow(visit, "sums binary, counts binary, least double, x binary, near binary").collect()  # k sums a partition, and EDGE_BYTES
        total, count = added([np.frombuffer(r["sums"]).reshape(centres.shape) for r in found]), sum(np.frombuffer(r["counts"], np.int64) for r in found)
        least = min(r["least"] for r in found)
        edge, near = np.concatenate([np.frombuffer(r["x"]) for r in found]).reshape(-1, centres.shape[1]), np.concatenate([np.frombuffer(r["near"], np.int64) for r in found])
        at, sums, counts, kept = centres, total, count, len(edge) or share == 1
        while True:
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
            rounds, moved = rounds + 1, float(((new - centres) ** 2).sum())
            step, centres = np.sort(np.sqrt(((new - centres) ** 2).sum(1)))[-2:].sum(), new
            if moved <= tolerance:
                return centres
            if most and rounds >= most:
                raise RuntimeError(f"centres still move after {most} rounds")
            if not np.isfinite(moved) or (place := hashlib.sha256(centres.tobytes()).digest()) in seen:
                raise RuntimeError(f"centres do not settle: after {rounds} rounds they {'are back at a former place' if np.isfinite(moved) else 'are no numbers'}")
            seen.add(place)
            if not kept or np.sort(np.sqrt(((centres - at) ** 2).sum(1)))[-2:].sum() >= least:
                break
            now = assigned(edge, centres)[0]
            other = np.flatnonzero(now != near)
            sums, counts = total.copy(), count.copy()
            for sign, of in ((1, now[other]), (-1, near[other])):
                np.add.at(sums, of, sign * edge[other])
                np.add.at(counts, of, sign)
        drift = step


def edges(blocks, c, share, keep):
    """One record of a partition: sums and numbers of the points by nearest centre, the smallest margin outside the ``share`` of the points with the smallest
    margins, and, if asked for, these points and their centres."""
    total, count, margins, held, n = np.zeros_like(c), np.zeros(len(c), dtype=np.int64), [np.zeros(0)], [], 0
    for x in blocks:
        near, margin = assigned(x, c)
        mine = np.zeros((len(x), len(c)))
        mine[np.arange(len(x)), near] = 1
        total, count, n = total + mine.T @ x, count + mine.sum(0).astype(np.int64), n + len(x)
        margins.append(margin)
        if keep:  # a bounded number of them at any time
            held.append((margin, near, x))
            most = max(1, int(EDGE_BYTES / (8 * c.shape[1])))
            if sum(len(m) for m, _, _ in held) > 2 * most:
                held = [smallest(held, most)]
    margins, number = np.concatenate(margins), n if share == 1 else int(share * n)
    least = np.inf if number >= n else float(np.partition(margins, number)[number])
    _, near, x = smallest(held, number) if held else (None, np.zeros(0, np.int64), np.zeros(0))
    values = {"sums": total.tobytes(), "counts": count.tobytes(), "least": least, "x": x.tobytes(), "near": near.astype(np.int64).tobytes()}
    return pa.RecordBatch.from_pydict({name: pa.array([v], pa.float64() if name == "least" else pa.binary()) for name, v in values.items()})


def smallest(held, number):
    """(margins, centres, points) of the ``number`` points with the smallest margins."""
    margin, near, x = (np.concatenate(part) for part in zip(*held, strict=True))
    rows = np.argsort(margin, kind="stable")[:number]
    return margin[rows], near[rows], x[rows]


def assigned(x, c):
    """(numbers of the nearest centres, ties to the smaller number, lower bounds of the margins).

    Squared distances come from one product; where its rounding could matter, they are formed from the differences."""
    far = (x * x).sum(1)
    d = far[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    scale = far + (c * c).sum(1).max()
    near, two = d.argmin(1), np.partition(d, 1, axis=1)[:, :2] if len(c) > 1 else np.stack([d[:, 0], np.full(len(x), np.inf)], 1)
    close = np.flatnonzero(~(two[:, 1] - two[:, 0] > 1e-12 * scale))
    near[close] = ((x[close][:, None] - c[None]) ** 2).sum(2).argmin(1)
    low, high = np.maximum(two[:, 1] - 1e-12 * scale, 0), np.maximum(two[:, 0] + 1e-12 * scale, 0)
    return near, np.sqrt(low) - np.sqrt(high) - 1e-9 * np.sqrt(scale)


def added(arrays):
    """Their sum, correctly rounded in any order."""
    flat = np.stack([a.ravel() for a in arrays])
    if not np.isfinite(flat).all():
        return flat.sum(0).reshape(arrays[0].shape)
    return np.array([math.fsum(v) for v in flat.T]).reshape(arrays[0].shape)


def packed(x):
    """The numbers as bytes, in single precision if that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def unpacked(data, n, d):
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * d else np.float64).reshape(n, d).astype(float)


def rows_of(column):
    if not column.null_count and not (flat := column.flatten()).null_count and len(flat) % len(column) == 0 and len(set(np.diff(column.offsets.to_numpy()))) == 1:
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float)


def apart(x, c):
    return np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(2))


def nearest(x, c, far, own):
    """(number of the nearest centre, its squared distance, distances measured), ties to the smaller number."""
    bound = np.maximum(np.abs(far[:, None, :] - own[None]).max(axis=2) - 1e-9 * (1 + far.max(axis=1)[:, None]), 0) ** 2
    near = bound.argmin(axis=1)
    best = ((x - c[near]) ** 2).sum(axis=1)
    first, measured = near.copy(), len(x)
    for i in range(len(c)):
        rows = np.flatnonzero((first != i) & (bound[:, i] <= best))
        measured += len(rows)
        d = ((x[rows] - c[i]) ** 2).sum(axis=1)
        closer = (d < best[rows]) | (d == best[rows]) & (i < near[rows])
        best[rows[closer]], near[rows[closer]] = d[closer], i
    return near, best, measured


@query("wl_17_kmeans", "WL-17")
def kmeans_by_hand(t):
    """Centres of the embeddings; a test compares the cost with the built-in estimator's."""
    pts = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    centres = kmeans(pts, 10)
    rows = [(i, j, float(v)) for i, c in enumerate(centres) for j, v in enumerate(c)]
    return t.spark.createDataFrame(rows, "centre int, dim int, value double").withColumn("value", F.round("value", 6))


SETTLED_CENTRES = """WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, x AS place FROM v QUALIFY k < 10),
""" + ",\n".join(f"""n{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(k, (list_distance(x, place), k)) AS k FROM v CROSS JOIN c{i} GROUP BY vec_id),
m{i} AS (SELECT k, list(m ORDER BY d) AS place FROM (SELECT k, d, favg(e) AS m FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS d FROM n{i}) GROUP BY ALL) GROUP BY 1), c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.place, c.place) AS place FROM c{i} c LEFT JOIN m{i} m USING (k))""" for i in range(40))


@query("wl_17_kmeans_sizes", "WL-17", SETTLED_CENTRES + " SELECT c.k::INTEGER AS centre, (SELECT count(*) FROM n39 n WHERE n.k = c.k) AS points, round(sqrt(list_sum(list_transform(place, lambda x: x * x))), 5) AS norm FROM c40 c")
def kmeans_sizes(t):
    """Points per centre once no centre moves any more."""
    centres = kmeans(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10, tolerance=0.0)

    def count(batches):
        n = np.zeros(len(centres), dtype=int)
        for b in batches:
            if b.num_rows:
                x = rows_of(b.column(0))
                np.add.at(n, nearest(x, centres, apart(x, centres[:1]), apart(centres, centres[:1]))[0], 1)
        yield pa.RecordBatch.from_pydict({"centre": pa.array(range(len(n)), pa.int32()), "points": pa.array(n, pa.int64())})

    norms = t.spark.createDataFrame([(i, float(np.linalg.norm(c))) for i, c in enumerate(centres)], "centre int, norm double")
    found = t.embeddings.select(F.col("embedding").cast("array<double>").alias("v")).mapInArrow(count, "centre int, points long").groupBy("centre").agg(F.sum("points").alias("points"))
    return norms.join(found, "centre").select("centre", "points", F.round("norm", 5).alias("norm"))


# twelve steps of plain gradient descent on labels 0 and 1
LOGISTIC = """WITH d AS MATERIALIZED (SELECT ln(1 + n_chars) / 10 AS x1, len(string_split_regex(text, '[!?]')) / greatest(n_chars, 1) * 10 AS x2, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)),
w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)""" + "".join(f""",
w{i + 1} AS MATERIALIZED (SELECT any_value(a) - 2 * avg(e) AS a, any_value(b) - 2 * avg(e * x1) AS b, any_value(c) - 2 * avg(e * x2) AS c FROM (SELECT *, 1 / (1 + exp(-(a + b * x1 + c * x2))) - y AS e FROM d CROSS JOIN w{i}))""" for i in range(12))


@query("wl_18_logistic_gradient", "WL-18", LOGISTIC + " SELECT round(a, 5) AS w0, round(b, 5) AS w1, round(c, 5) AS w2, (SELECT count(*) FROM d) AS rows FROM w12")
def logistic_gradient(t):
    """Batch gradient descent, twelve steps: each is one aggregate of the misses, predicted probability less label; the driver holds three weights."""
    d = t.documents.select("doc_id", (F.log1p("n_chars") / 10).alias("x1"), (F.size(F.split("text", "[!?]")) / F.greatest(F.col("n_chars"), F.lit(1)) * 10).alias("x2")).join(t.labels, "doc_id")
    d = cut(d.select("x1", "x2", F.col("quality").cast("double").alias("y")), "points")
    w, n = np.zeros(3), 0
    for _ in range(12):
        inputs = (F.lit(1.0), F.col("x1"), F.col("x2"))
        score = sum((F.lit(float(k)) * x for k, x in zip(w, inputs)), F.lit(0.0))
        miss = 1 / (1 + F.exp(-score)) - F.col("y")
        n, *slope = d.agg(F.count("*"), *[exact_sum(miss * x) for x in inputs]).first()
        if not n:
            break
        w = w - 2.0 * np.array(slope) / n
    return t.spark.createDataFrame([(round(float(w[0]), 5), round(float(w[1]), 5), round(float(w[2]), 5), n)], "w0 double, w1 double, w2 double, rows long")


@query("wl_20_column_similarity", "WL-20 ML-14", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), n AS (SELECT j, sqrt(sum(v * v)) AS norm FROM x GROUP BY 1)
SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v) / (any_value(na.norm) * any_value(nb.norm)), 5) AS cosine FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.j < b.j JOIN n na ON na.j = a.j JOIN n nb ON nb.j = b.j GROUP BY a.j, b.j""")
def column_similarity(t):
    """The Gram matrix of the columns: one partial product per partition, added by Spark. Its size is set by the
    number of columns, whatever the number of rows."""
    def gram(batches):
        g = None
        for b in batches:
            if b.num_rows:
                x = rows_of(b.column(0))
                g = x.T @ x if g is None else g + x.T @ x
        if g is not None:
            i, j = np.triu_indices(g.shape[0])
            yield pa.RecordBatch.from_pydict({"i": i.astype("int64"), "j": j.astype("int64"), "s": g[i, j]})

    g = t.embeddings.select("embedding").mapInArrow(gram, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    g = cut(g, "gram")
    norms = g.filter("i = j").select(F.col("i").alias("k"), F.sqrt("s").alias("norm"))
    a, b = norms.toDF("i", "ni"), norms.toDF("j", "nj")
    return g.filter("i < j").join(a, "i").join(b, "j").select("i", "j", F.round(F.col("s") / (F.col("ni") * F.col("nj")), 5).alias("cosine"))


@query("wl_20_sampled_similarity", "WL-20")
def sampled_similarity(t):
    """Similarities from a row sample against the exact ones, with the mean absolute difference."""
    exact = column_similarity(t)
    half = type(t)(t.spark, t.folder)

    class Sampled:
        spark, folder = t.spark, t.folder
        embeddings = half.embeddings.sample(0.5, seed=5)

    approx = column_similarity(Sampled).withColumnRenamed("cosine", "approx")
    return exact.join(approx, ["i", "j"], "left").agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("cosine") - F.coalesce("approx", F.lit(0.0)))), 5).alias("mean_abs_error"))


@query("wl_21_typed_aggregates", "WL-21 RD-04", """
SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total, count(*) AS n, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1""")
def typed_aggregates(t):
    """A user aggregate as zero / reduce / merge / finish: a buffer per Arrow batch and segment, merged by Spark."""
    def reduce_batch(frames):
        for f in frames:
            g = f.groupby("c_mktsegment")["c_acctbal"].agg(["sum", "count", "min", "max"]).reset_index()
            yield g.set_axis(["c_mktsegment", "s", "n", "lo", "hi"], axis=1)

    buffers = t.customer.select("c_mktsegment", "c_acctbal").mapInPandas(reduce_batch, "c_mktsegment string, s double, n long, lo double, hi double")
    merged = buffers.groupBy("c_mktsegment").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.select("c_mktsegment", F.round("s", 2).alias("total"), "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"), "lo", "hi")


@query("wl_22_sql_basics", "WL-22 SRC-23 SRC-26 SRC-27 RD-11", """
SELECT r_name, count(*) AS customers, max(c_acctbal) AS richest FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('ASIA'), ('EUROPE'), ('AFRICA')) w(name) ON name = r_name GROUP BY 1""")
def sql_basics(t):
    spark = t.views("customer", "nation")
    t.region.createOrReplaceGlobalTempView("joulemill_region")
    wanted = spark.createDataFrame([("ASIA",), ("EUROPE",), ("AFRICA",)], "name string")
    wanted.createOrReplaceTempView("joulemill_wanted")
    return spark.sql("""SELECT r_name, count(*) AS customers, max(c_acctbal) AS richest FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN global_temp.joulemill_region ON n_regionkey = r_regionkey JOIN joulemill_wanted ON name = r_name GROUP BY r_name""")


@query("wl_26_udf_filter", "WL-26 UDM-09", "SELECT p_brand, count(*) AS n, true AS in_range FROM part WHERE length(p_name) % 2 = 0 GROUP BY 1")
def udf_filter(t):
    """A Python predicate in a filter, and a column function marked non-deterministic so it is not re-evaluated."""
    even = F.udf(lambda s: len(s) % 2 == 0, "boolean")

    @F.pandas_udf("double")
    def noise(s: pd.Series) -> pd.Series:
        return pd.Series(np.random.default_rng().random(len(s)))

    x = t.part.filter(even("p_name")).withColumn("u", noise.asNondeterministic()("p_size"))
    return x.groupBy("p_brand").agg(F.count("*").alias("n"), F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_range"))


@query("wl_27_stratified_sample", "WL-27", """
SELECT o_orderpriority, ceil(count(*) * 0.1)::BIGINT AS exact, true AS near FROM orders GROUP BY 1""")
def stratified_sample(t):
    """Exact strata sizes by a seeded random order, and the one-pass random form within its expected spread."""
    o = t.orders.select("o_orderkey", "o_orderpriority")
    sizes = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    shuffled = positions(o.withColumn("u", F.xxhash64("o_orderkey", F.lit(42))), ["o_orderpriority"], [F.col("u"), F.col("o_orderkey")], "p")
    exact = shuffled.join(sizes, "o_orderpriority").filter(F.col("p") <= F.ceil(F.col("n") * 0.1)).groupBy("o_orderpriority").agg(F.count("*").alias("exact"))
    loose = o.sampleBy("o_orderpriority", {p: 0.1 for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}, 9).groupBy("o_orderpriority").agg(F.count("*").alias("k"))
    return sizes.join(exact, "o_orderpriority").join(loose, "o_orderpriority").select("o_orderpriority", "exact", (F.abs(F.col("k") - F.col("n") * 0.1) < 6 * F.sqrt(F.col("n") * 0.1 + 1)).alias("near"))


@query("wl_28_record_files", "WL-28", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def record_files(t):
    return t.spark.read.format("parquet").load(t.path("part")).groupBy("p_type").agg(F.count("*").alias("n"))


@query("wl_29_input_helpers", "WL-29", """
SELECT 'lines' AS helper, count(*) AS n FROM region UNION ALL SELECT 'whole', count(*) FROM region UNION ALL SELECT 'binary', sum(length(r_name) + 1)::BIGINT FROM region UNION ALL SELECT 'range', count(*) FROM orders UNION ALL SELECT 'collection', count(*) FROM region""")
def input_helpers(t):
    path = scratch(t.spark, "helpers")
    t.region.select(F.col("r_name").alias("value")).write.text(path)
    spark = t.spark
    parts = {"lines": spark.read.text(path).agg(F.count("*")), "whole": spark.read.text(path, wholetext=True).agg(F.sum(F.regexp_count("value", F.lit("\n")))), "binary": spark.read.format("binaryFile").load(path + "/*.txt").agg(F.sum("length")),
             "range": spark.range(t.orders.count()).agg(F.count("*")), "collection": spark.createDataFrame([(r["r_name"],) for r in t.region.toLocalIterator()], "name string").agg(F.count("*"))}
    out = None
    for name, df in parts.items():
        part = df.toDF("n").select(F.lit(name).alias("helper"), F.col("n").cast("long").alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("wl_30_delays", "WL-30", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, round(avg(epoch(l_shipdate) - epoch(o_orderdate)) / 86400, 5) AS lag_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1""")
def delays(t):
    l = t.lineitem.filter("l_linestatus = 'F'").select("l_orderkey", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_orderdate")
    lag = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(lag) / 86400, 5).alias("lag_days"))
