"""Approximate nearest neighbours by largest inner product: stable projections and kd-trees.

Vectors get one more coordinate that makes their norms equal, so the largest inner product is the smallest distance, and are projected by a Gaussian
matrix to a few dimensions; a projected squared distance over the true one follows a chi-square law. A kd-tree over the projections, split on a
bounded sample, deals all rows out to cells. A query searches its own cell first, then every cell whose box the test cannot rule out, and within a
cell the leaves of its kd-tree from the nearest on. It stops where a point as near as the worst of its neighbours would have been projected
nearer with probability CONFIDENCE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from joulemill.llm.registry import query, table
from joulemill.storage import cut

NEIGHBOURS = 20
DIMENSIONS = 8
QUANTILE = 16.0  # of the chi-square law with 8 degrees of freedom, at CONFIDENCE = 0.958
SAMPLE = 65_536  # rows that place the cells' walls
CELL = 2_048  # rows in a cell, about
MOST_CELLS = 4_096
BLOCK = 4_096  # rows, and queries, that one task takes of a cell at once
LEAF = 128


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): rows with an id and a vector without null or non-finite components that isn't zero."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def matrix(width: int) -> np.ndarray:
    return np.random.default_rng(9).normal(size=(width + 1, DIMENSIONS))


def projected(v: np.ndarray, norm: float, as_query: bool = False) -> np.ndarray:
    last = np.zeros(len(v)) if as_query else np.sqrt(np.maximum(norm * norm - (v * v).sum(axis=1), 0))
    return np.concatenate([v, last[:, None]], axis=1) @ matrix(v.shape[1])


def walls(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(dimension, value) of the inner nodes of a kd-tree in heap order; the widest dimension is halved at its median."""
    found: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    at = [points] + [points[:0]] * (len(found) - 1) + [points[:0]] * (1 << depth)
    for node in range(len(found)):
        p = at[node]
        d = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
        w = float(np.median(p[:, d])) if len(p) else 0.0
        found[node] = (d, w)
        at[2 * node + 1], at[2 * node + 2] = p[p[:, d] <= w], p[p[:, d] > w]
    return found


def cell_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), dtype=np.int64)
    dims, values = np.array([t[0] for t in tree], dtype=np.int64), np.array([t[1] for t in tree])
    while len(tree) and len(points) and node[0] < len(tree):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > values[node])
    return node - len(tree)


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree with at most LEAF points each (or more, if they are all equal)."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= LEAF or not spread.max() > 0:
            done.append(rows)
            continue
        x = points[rows, spread.argmax()]
        low = x <= np.median(x)
        if low.all():
            low = x < x.max()
        todo += [rows[low], rows[~low]]
    return done


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return out


def search(ids: np.ndarray, v: np.ndarray, queries: pd.DataFrame, norm: float) -> pd.DataFrame:
    """The best of the rows for each query (query_id, v, bound): leaves from the nearest on, until the test holds. ``bound`` is a score that
    the worst neighbour is known to reach (null: none yet)."""
    q, qid = np.stack(queries["v"].to_numpy()), queries["query_id"].to_numpy()
    points, asked = projected(v, norm), projected(q, norm, as_query=True)
    parts = leaves(points)
    low, high = np.stack([points[p].min(axis=0) for p in parts]), np.stack([points[p].max(axis=0) for p in parts])
    apart = box_distance(asked, low, high)
    order = np.argsort(apart, axis=1, kind="stable")
    known = queries["bound"].to_numpy(dtype=float)
    best = np.full((len(q), NEIGHBOURS), -np.inf)
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qid]
    length = (q * q).sum(axis=1) + norm * norm
    active = np.arange(len(q))
    for rank in range(len(parts)):
        worst = np.fmax(known[active], best[active, -1])
        far = np.maximum(length[active] - 2 * np.where(np.isfinite(worst), worst, -np.inf), 0)
        leaf = order[active, rank]
        on = apart[active, leaf] < QUANTILE * far
        on |= apart[active, leaf] == 0
        active, leaf = active[on], leaf[on]
        if not len(active):
            break
        for k in np.unique(leaf):
            who, rows = active[leaf == k], parts[k]
            scores = q[who] @ v[rows].T
            scores[qid[who, None] == ids[rows]] = -np.inf
            merged = np.concatenate([best[who], scores], axis=1)
            best[who] = -np.partition(-merged, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
            best[who] = -np.sort(-best[who], axis=1)
            # All that may still be among the best, with room for the rounding of the product; ties stay in.
            near = scores >= (np.fmax(known[who], best[who, -1]) - 1e-9 * (1 + norm * norm))[:, None]
            for i, hit in zip(who, near & np.isfinite(scores)):
                if hit.any():
                    kept[i].append(rows[hit])
    found = []
    for i, chunks in enumerate(kept):
        if chunks:
            rows = np.concatenate(chunks)
            exact = (v[rows] * q[i]).sum(axis=1)
            top = np.lexsort((ids[rows], -exact))[:NEIGHBOURS]
            found.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[rows][top], "score": exact[top]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": qid[:0], "vec_id": ids[:0], "score": best[:0, 0]})


def nearest(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score): the NEIGHBOURS nearest found for each row of ``queries``, its own id left out.

    Both have (vec_id, embedding). Rows with a null id, a null or zero vector, null or non-finite components, or another number of components than
    most rows (of equally frequent numbers the smaller counts), take no part. With fewer candidates all are returned; equal scores go to the smaller id; repeated ids count as rows of
    their own, repeated queries are asked once; empty tables give no rows. A cell with many equal vectors is split over
    tasks by row, and so are its queries."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))
    usual = sizes.orderBy(F.desc("n"), "width").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, norm = usual
    rows, asked = rows.filter(F.size("v") == width), asked.filter(F.size("v") == width)
    depth = min(max(0, int(np.ceil(np.log2(n / CELL)))), int(np.log2(MOST_CELLS)))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas() if depth else None
    tree = walls(projected(np.stack(some["v"].to_numpy()), norm), depth) if depth else []

    def place(frames: Iterator[pd.DataFrame], as_query: bool = False) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                p = projected(np.stack(f["v"].to_numpy()), norm, as_query)
                yield f.assign(p=list(p), cell=cell_of(p, tree))

    spot = "vec_id long, v array<double>, p array<double>, cell long"
    indexed = cut(rows.mapInPandas(place, spot), "indexed")
    asked = cut(asked.mapInPandas(lambda frames: place(frames, True), spot).withColumnRenamed("vec_id", "query_id"), "queries")
    sides = [f(F.get("p", F.lit(d))).alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(DIMENSIONS)]
    cells = indexed.groupBy("cell").agg(F.count("*").alias("n"), *sides).toPandas()  # MOST_CELLS rows at most
    low, high = (cells[[f"{s}{d}" for d in range(DIMENSIONS)]].to_numpy() for s in ("min", "max"))
    blocks = spark.createDataFrame([(int(c), -(-int(m) // BLOCK)) for c, m in zip(cells["cell"], cells["n"])], "cell long, blocks long")

    def run(key, block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return search(block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy()), ask, norm)

    def visit(pairs: DataFrame) -> DataFrame:
        """Searches the (cell, query_id, v, bound), a block of rows and a block of queries at a time."""
        shape = pairs.groupBy("cell").agg(F.count("*").alias("asks")).join(blocks, "cell").withColumn("turns", F.ceil(F.col("asks") / BLOCK))
        parts = lambda df, own, other, name, by: df.join(F.broadcast(shape), "cell").withColumn(name, F.pmod(F.xxhash64(by), F.col(own))).withColumn({"block": "turn", "turn": "block"}[name], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        left = parts(indexed.select("cell", "vec_id", "v"), "blocks", "turns", "block", "vec_id").select("cell", "block", "turn", "vec_id", "v")
        right = parts(pairs, "turns", "blocks", "turn", "query_id").select("cell", "block", "turn", "query_id", "v", "bound")
        return left.groupBy("cell", "block", "turn").cogroup(right.groupBy("cell", "block", "turn")).applyInPandas(run, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEIGHBOURS)
    home = cut(best(visit(asked.select("cell", "query_id", "v", F.lit(None).cast("double").alias("bound")))), "home")
    bound = home.filter(F.col("rank") == NEIGHBOURS).select("query_id", F.col("score").alias("bound"))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = cells["cell"].to_numpy()
        for f in frames:
            for g in (f.iloc[i : i + 1024] for i in range(0, len(f), 1024)):
                v = np.stack(g["v"].to_numpy())
                far = np.maximum((v * v).sum(axis=1) + norm * norm - 2 * g["bound"].fillna(-np.inf).to_numpy(), 0)
                who, which = np.nonzero((box_distance(np.stack(g["p"].to_numpy()), low, high) < QUANTILE * far[:, None]) & (names != g["cell"].to_numpy()[:, None]))
                yield pd.DataFrame({"cell": names[which], "query_id": g["query_id"].to_numpy()[who], "v": pd.Series(list(v[who]), dtype=object), "bound": g["bound"].to_numpy()[who]})

    more = cut(asked.join(bound, "query_id", "left").mapInPandas(spread, "cell long, query_id long, v array<double>, bound double"), "visits")
    both = home.select("query_id", "vec_id", "score").union(visit(more))
    return best(both).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op9_ann")
def op9_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
