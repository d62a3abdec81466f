"""Exact top-k by inner product: vectors in buckets of similar length, pruned by length or by coordinate, then verified.

Rows are range-partitioned by falling length into buckets. Queries visit the longest buckets first, in waves of four times as many buckets; after
each wave a query's k-th score is its floor, and a bucket whose longest vector cannot reach it is left out. Inside a bucket the floor over both
lengths is a cosine that a row must reach. Where it is high, the query's largest coordinates confine a row's to narrow ranges, looked up in sorted
lists; where it is low, only rows too short to reach the floor are passed over. What is left is verified by its integer product.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from joulemill.llm.registry import query, table
from joulemill.storage import cut, scratch

NEIGHBOURS = 20
SCALE = 64
BUCKET = 8_192  # rows in a bucket, about, and in a part of it that one task takes
MOST_BUCKETS = 4_096  # beyond, buckets hold more parts
QUERIES = 1_024  # queries that one task takes
WAVE = 4  # a wave has so many times the buckets of all before it, less one
STEEP = 0.7  # local cosine from which on coordinates prune
FOCUS = 4  # coordinates of a query that are looked up
SLACK = 1e-9  # relative; bounds are in floating point, products in integers
LIMIT = 1 << 62
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, z array<long>, norm): rows with an id and a vector without null or non-finite components, scaled and floored."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.col("vec_id").isNotNull()
    z = F.transform(x, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * F.lit(float(scale))))))
    df = vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), z.alias("z"))
    return df.withColumn("norm", F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter vectors end in zeros."""
    array = column.combine_chunks()
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    sizes = np.diff(array.offsets.to_numpy())
    out = np.zeros((len(array), width), dtype=np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = array.flatten().to_numpy(zero_copy_only=False)
    return out


def longest(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(chunk.offsets.to_numpy()).max(initial=0)) for c in columns for chunk in c.chunks), default=0)


class Bucket:
    """Part of a bucket: different vectors by falling length, each with its ids."""

    def __init__(self, ids: np.ndarray, z: np.ndarray):
        order = np.lexsort((ids, *z.T)) if z.shape[1] else np.argsort(ids, kind="stable")
        z, ids = z[order], ids[order]
        new = np.ones(len(z), dtype=bool)
        new[1:] = (z[1:] != z[:-1]).any(axis=1)
        self.starts = np.append(np.flatnonzero(new), len(z))
        norms = np.sqrt((z[new].astype(float) ** 2).sum(axis=1))
        down = np.argsort(-norms, kind="stable")
        self.ids, self.first, self.last = ids, self.starts[:-1][down], self.starts[1:][down]
        self.z, self.norms = z[new][down], norms[down]
        self.values = self.z.astype(float)
        #: The id of a vector that only one id has, and whether that is so: a query doesn't meet its own.
        self.sole, self.alone = ids[self.first], ids[self.first] == ids[self.last - 1]

    @cached_property
    def units(self) -> np.ndarray:
        return self.values / np.maximum(self.norms, 1e-300)[:, None]

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Per coordinate the rows in order of their unit vectors' values, and the values."""
        order = np.argsort(self.units, axis=0, kind="stable")
        return order, np.take_along_axis(self.units, order, axis=0)

    def near(self, q: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that may have at least this cosine with q: the angle to an axis differs from the query's by no more than the angle between the two."""
        unit = q / np.sqrt((q * q).sum())
        order, values = self.lists
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        own, wide = np.arccos(np.clip(unit[focus], -1, 1)), math.acos(min(1.0, cosine))
        low, high = np.cos(np.minimum(np.pi, own + wide)) - SLACK, np.cos(np.maximum(0, own - wide)) + SLACK
        cuts = [(np.searchsorted(values[:, f], a, "left"), np.searchsorted(values[:, f], b, "right")) for f, a, b in zip(focus, low, high)]
        best = min(range(len(focus)), key=lambda i: cuts[i][1] - cuts[i][0])
        rows = order[cuts[best][0] : cuts[best][1], focus[best]]
        inside = (self.units[rows][:, focus] >= low) & (self.units[rows][:, focus] <= high)
        return rows[inside.all(axis=1)]

    def take(self, rows: np.ndarray, scores: list[int], own: int, k: int) -> list[tuple[int, int]]:
        """The best k (id, score) of the vectors ``rows``, ties to smaller ids, the query's own id left out."""
        found = []
        for r, s in zip(rows, scores):
            ids = self.ids[self.first[r] : self.last[r]]
            some = ids[:k]
            if (some == own).any():
                some = ids[ids != own][:k]
            found += [(-s, i) for i in some.tolist()]
        return [(i, -s) for s, i in sorted(found)[:k]]

    def products(self, rows: np.ndarray, q: np.ndarray, exact: bool, approximate: np.ndarray) -> list[int]:
        """Integer products, held within a long."""
        if exact:
            return [int(s) for s in approximate]
        return [max(-LONG, min(LONG, int(s))) for s in self.z[rows].astype(object) @ q.astype(object)]

    def search(self, qids: np.ndarray, qz: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score): the best k here of every query, of those that reach its floor (NaN: none yet)."""
        out: list[tuple[int, int, int]] = []
        queries = qz.astype(float)
        lengths = np.sqrt((queries * queries).sum(axis=1))
        floors = np.where(np.isnan(floors), -np.inf, floors)
        reach = lengths * self.norms[0] * (1 + SLACK)
        cosine = np.where(reach > 0, floors / np.maximum(reach, 1e-300), -np.inf)
        lists = (cosine >= STEEP) & (floors <= reach)

        def verify(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
            other = ~(self.alone[rows] & (self.sole[rows] == qids[i]))
            rows, scores = rows[other], scores[other]
            exact = reach[i] < EXACT
            slack = 0.0 if exact else 1e-12 * reach[i]
            least = max(floors[i], np.partition(scores, -k)[-k] if len(scores) > k else -np.inf)
            least = min(least, float(LONG)) - 2 * slack  # what is held at the largest long is equal
            rows, scores = rows[scores >= least], scores[scores >= least]
            out.extend((int(qids[i]), v, s) for v, s in self.take(rows, self.products(rows, qz[i], exact, scores), int(qids[i]), k))

        for i in np.flatnonzero(lists):
            rows = self.near(queries[i], float(cosine[i]))
            if len(rows):
                verify(i, rows, self.values[rows] @ queries[i])
        # Length pruning: rows as long as the floor asks are a prefix; queries of similar prefixes share one product.
        need = np.where(lengths > 0, floors / np.maximum(lengths, 1e-300), np.where(floors > 0, np.inf, -np.inf)) * (1 - SLACK) - SLACK
        prefix = np.where(lists | (floors > reach), 0, np.searchsorted(-self.norms, -need, "right"))
        order = np.argsort(prefix, kind="stable")
        order = order[prefix[order] > 0]
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            scores = queries[some] @ self.values[: prefix[some].max()].T
            for i, row in zip(some, scores):
                verify(i, np.arange(prefix[i]), row[: prefix[i]])
        return out


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def largest_products(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the largest integer products, for each row of ``queries``, without its own id.

    Both have (vec_id, embedding); other columns are not read. Rows with a null id, a null vector or null or non-finite components take no part.
    Vectors of different length are multiplied over the components both have (an empty or zero vector scores 0). With fewer than k candidates all
    are returned; equal scores go to the smaller id; repeated rows are candidates of their own; of queries that repeat an id the vector that comes
    first in order is asked. Scaled components are held within 2**62 and scores within a long. Empty tables give no rows.

    A bucket is a range of lengths, split by row where many rows are equally long, so that a hot vector or id is dealt over tasks; equal vectors in
    a task are multiplied once. A task returns at most k rows for a query."""
    spark = vectors.sparkSession
    rows = scaled(vectors, scale)
    asked = cut(scaled(queries, scale).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("z", "norm")).alias("q")).select("query_id", "q.*"), "queries")
    buckets = min(MOST_BUCKETS, -(-rows.count() // BUCKET))
    if not buckets:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    path = scratch(spark, "buckets")
    ranged = rows.withColumn("slot", F.monotonically_increasing_id()).repartitionByRange(buckets, F.desc("norm"), F.col("slot"))
    ranged.withColumn("bucket", F.spark_partition_id()).write.parquet(path)
    indexed = spark.read.parquet(path)
    # One row for a bucket, so their number is bounded by MOST_BUCKETS.
    shape = sorted(indexed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect(), key=lambda r: r["bucket"])
    numbers, most = [r["bucket"] for r in shape], {r["bucket"]: r["most"] for r in shape}
    sizes = spark.createDataFrame([(r["bucket"], -(-r["n"] // BUCKET)) for r in shape], "bucket int, parts long")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            width = longest(left["z"], right["z"])
            part = Bucket(left["vec_id"].to_numpy(), dense(left["z"], width))
            found = part.search(right["query_id"].to_numpy(), dense(right["z"], width), right["floor"].to_numpy().astype(float), k)
        return pa.table({name: pa.array([f[i] for f in found], pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score"))})

    def visit(pairs: DataFrame) -> DataFrame:
        """Searches (bucket, query_id, z, floor), a part of a bucket and a block of queries at a time."""
        cells = pairs.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES).alias("turns")).join(F.broadcast(sizes), "bucket")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        left = indexed.join(F.broadcast(cells), "bucket").select("bucket", F.pmod(F.xxhash64("slot"), "parts").alias("part"), every(F.col("turns")).alias("turn"), "vec_id", "z")
        right = pairs.join(F.broadcast(cells), "bucket").select("bucket", every(F.col("parts")).alias("part"), F.pmod(F.xxhash64("query_id"), "turns").alias("turn"), "query_id", "z", "floor")
        return left.groupBy("bucket", "part", "turn").cogroup(right.groupBy("bucket", "part", "turn")).applyInArrow(tile, "query_id long, vec_id long, score long")

    best, begin, many = None, 0, 1
    while begin < len(numbers):
        wave = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(most[b]).alias("most")) for b in numbers[begin : begin + many]])
        known = asked.withColumn("floor", F.lit(None).cast("long"))
        if best is not None:
            floor = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
            known = asked.join(floor, "query_id", "left")
        open_ = F.filter(wave, lambda b: F.col("floor").isNull() | (b["most"] * F.col("norm") * (1 + SLACK) >= F.col("floor")))
        pairs = known.select("query_id", "z", "floor", F.explode(open_).alias("b")).select("b.bucket", "query_id", "z", "floor")
        found = visit(pairs)
        best = cut(top(found if best is None else best.select(found.columns).unionByName(found), k), "best")
        begin, many = begin + many, (begin + many) * (WAVE - 1)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
q AS MATERIALIZED (SELECT vec_id AS query_id, min(z) AS z FROM v WHERE vec_id % 20 = 0 GROUP BY 1),
scored AS (SELECT query_id, vec_id, coalesce(list_sum(list_transform(list_zip(q.z, v.z), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score FROM q JOIN v ON v.vec_id <> q.query_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored QUALIFY rank <= {NEIGHBOURS}"""


@query("op11_topk", SQL)
def op11_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return largest_products(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
