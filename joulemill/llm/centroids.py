"""Centroid clustering with a table of pivot distances (LAESA), exact on integer vectors.

Components are scaled and floored to integers. Every vector's distances to a few fixed pivots are written once beside the vector. A round knows the
distances of its centroids to the same pivots; by the triangle inequality the difference of the two, at any pivot, is a lower bound of the
distance between vector and centroid. The centroid with the lowest bound is measured first, then only those whose bound doesn't exceed the best
distance so far, all in integers. Sums leave a partition once and are added by Spark; the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from joulemill.llm.registry import query, table
from joulemill.storage import cut

COMPONENTS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
PIVOTS = 16
SEED = 3
LIMIT = 1 << 62  # scaled components are held within this, so that they and their sums have an exact type
SMALL = 1 << 27  # up to here a squared distance of 64 components fits 64 bits
LONG = (1 << 63) - 1


def usable(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, z array<long>): the vectors with the right number of components, none null or non-finite, scaled and floored."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) == components) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    z = F.transform(x, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * F.lit(float(scale))))))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), z.alias("z"))


def first_by_hash(rows: DataFrame, n: int, seed: int = SEED) -> list[list[int]]:
    """The n vectors with the smallest sha256 of ``seed:vec_id``; a null id comes last, equal ids go by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r["z"]) for r in rows.orderBy(digest.asc_nulls_last(), "z").limit(n).collect()]


def integers(values: list[list[int]] | np.ndarray, big: bool) -> np.ndarray:
    return np.array(values, dtype=object if big else np.int64)


def squared(z: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = z - centre
    return (apart * apart).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.array([math.sqrt(s) for s in squares]) if squares.dtype == object else np.sqrt(squares.astype(float))


def assign(z: np.ndarray, to: np.ndarray, centres: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances measured) for vectors z with pivot distances ``to`` and centroids with ``at``.

    A bound gives way by more than the rounding of the roots, so no centroid at the same distance is passed over; of equally near ones the
    smallest number wins."""
    slack = 1e-12 * (to.max(axis=1)[:, None] + at.max(axis=1)[None])
    bound = np.zeros((len(z), len(centres)))
    for p in range(to.shape[1]):
        np.maximum(bound, np.abs(to[:, p, None] - at[None, :, p]) - slack, out=bound)
    bound *= bound
    cluster = bound.argmin(axis=1)
    best = np.empty(len(z), dtype=z.dtype)
    for k in range(len(centres)):
        rows = np.flatnonzero(cluster == k)
        best[rows] = squared(z[rows], centres[k])
    first, measured = cluster.copy(), len(z)
    for k in range(len(centres)):
        rows = np.flatnonzero((first != k) & (bound[:, k] <= best.astype(float) * (1 + 1e-12)))
        measured += len(rows)
        apart = squared(z[rows], centres[k])
        nearer = (apart < best[rows]) | (apart == best[rows]) & (k < cluster[rows])
        best[rows[nearer]], cluster[rows[nearer]] = apart[nearer], k
    return cluster, best, measured


def vectors_of(batch: pa.RecordBatch, components: int, centres: list[list[int]]) -> tuple[np.ndarray, bool]:
    """The batch's vectors as 64-bit integers, or as Python's where a squared distance could pass 64 bits."""
    z = batch.column("z").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)
    big = bool(len(z)) and max(int(z.max()), -int(z.min()), *(abs(c) for centre in centres for c in centre)) > SMALL
    return (z.astype(object) if big else z), big


def centroids(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every row of ``vectors`` (vec_id, embedding) that is usable.

    Null vectors, those of another length and those with null or non-finite components take no part; a null id does, and comes last in the choice
    of the starts. Repeated rows count as often as they occur. Equal distances go to the smaller cluster; a cluster without vectors keeps its
    centroid. With fewer vectors than clusters there are fewer clusters, and an empty table gives no rows. Scaled components are held within
    2**62; distances and inertias are exact and shown as at most 2**63 - 1. Other columns are not read."""
    spark = vectors.sparkSession
    rows = usable(vectors, components, scale)
    fixed = first_by_hash(rows, max(pivots, clusters), seed)
    centres, fixed = fixed[:clusters], fixed[:pivots]
    if not centres:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, big = vectors_of(batch, components, fixed)
            to = np.stack([roots(squared(z, integers(p, big))) for p in fixed], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("z"), pa.array(list(to), pa.list_(pa.float64()))], names=["vec_id", "z", "pivots"])

    measured = cut(rows.mapInArrow(measure, "vec_id long, z array<long>, pivots array<double>"), "pivots")

    def nearest(batch: pa.RecordBatch, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, big = vectors_of(batch, components, centres + fixed)
        to = batch.column("pivots").flatten().to_numpy(zero_copy_only=False).reshape(len(z), -1)
        at = np.stack([roots(squared(integers(centres, big), integers(p, big))) for p in fixed], axis=1)
        return z, *assign(z, to, integers(centres, big), at)[:2]

    def summed(centres: list[list[int]]):
        """A partition's sums and, at position ``components``, counts per cluster."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((len(centres), components + 1), dtype=object)
            for batch in batches:
                if batch.num_rows:
                    z, cluster, _ = nearest(batch, centres)
                    for k in np.unique(cluster):
                        totals[k, :-1] += z[cluster == k].astype(object).sum(axis=0)
                        totals[k, -1] += int((cluster == k).sum())
            k, p = np.nonzero(totals[:, -1] > 0)[0].repeat(components + 1), np.tile(np.arange(components + 1), int((totals[:, -1] > 0).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array([Decimal(int(t)) for t in totals[k, p]], pa.decimal128(38, 0))], names=["cluster", "position", "total"])

        return run

    for _ in range(rounds):
        sums = measured.mapInArrow(summed(centres), "cluster int, position int, total decimal(38,0)").groupBy("cluster", "position").agg(F.sum("total").alias("total"))
        found = {(r["cluster"], r["position"]): int(r["total"]) for r in sums.collect()}  # clusters * (components + 1) rows at most
        centres = [[found[k, p] // found[k, components] for p in range(components)] if (k, components) in found else centre for k, centre in enumerate(centres)]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = nearest(batch, centres)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array([Decimal(int(d)) for d in distance], pa.decimal128(38, 0))], names=["vec_id", "cluster", "apart"])

    assigned = cut(measured.mapInArrow(final, "vec_id long, cluster int, apart decimal(38,0)"), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum("apart").alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    named = spark.createDataFrame([(k, min(LONG, i), min(LONG, sum(inertia.values())), digest[k]) for k, i in inertia.items()] or [], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    distance = F.least("apart", F.lit(Decimal(LONG))).cast("long").alias("distance")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", distance, "cluster_inertia", "inertia", "centroid_sha256")


def rounds_sql() -> str:
    """The same rounds in SQL: all distances, the nearest centroid, new centroids."""
    apart = "list_sum(list_transform(list_zip(v.z, c.z), lambda p: (p[1] - p[2])::HUGEINT * (p[1] - p[2])))"
    floor = "(s - ((s % n) + n) % n) // n"
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT v.row, arg_min(c.k, d.apart * {CLUSTERS} + c.k) AS k, min(d.apart) AS apart FROM v CROSS JOIN c{i} c CROSS JOIN LATERAL (SELECT {apart} AS apart) d GROUP BY v.row)"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS z FROM embeddings
          WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR) NULLS LAST, z) - 1 AS k, z FROM v QUALIFY k < {CLUSTERS})",
    ]
    for i in range(ROUNDS):
        steps += [
            near(i),
            f"s{i} AS (SELECT k, u.p, sum(u.c)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN v USING (row) CROSS JOIN LATERAL (SELECT unnest(v.z) AS c, generate_subscripts(v.z, 1) AS p) u GROUP BY 1, 2)",
            f"n{i} AS (SELECT k, list(({floor})::BIGINT ORDER BY p) AS z FROM s{i} GROUP BY 1)",
            f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.z, c.z) AS z FROM c{i} c LEFT JOIN n{i} n ON n.k = c.k)",
        ]
    return "WITH " + ",\n".join([*steps, near(ROUNDS)]) + f"""
      SELECT v.vec_id, a.k::INTEGER AS cluster, a.apart::BIGINT AS distance, (sum(a.apart) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
        (sum(a.apart) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.z, ',')) AS centroid_sha256
      FROM a{ROUNDS} a JOIN v USING (row) JOIN c{ROUNDS} c ON c.k = a.k"""


@query("op12_centroids", rounds_sql())
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids(table(spark, folder, "embeddings"))
