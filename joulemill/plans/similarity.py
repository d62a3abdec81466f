"""Similarity join of sets by banded min-hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from joulemill.storage import cut

BANDS, ROWS = 24, 2  # a pair of similarity s meets with probability 1 - (1 - s**ROWS)**BANDS: 0.985 at 0.4, 0.99997 at 0.6
MOST_PAIRS = 10_000  # of one band value; beyond, its members meet its smallest ids only


def min_hash(items: Column, seed: int) -> Column:
    return F.array_min(F.transform(items, lambda x: F.xxhash64(x, F.lit(seed))))


def banded(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, band): one value per band, equal for sets that agree in all ``rows`` min-hashes of it (and-or construction)."""
    values = [F.xxhash64(F.lit(b), *[min_hash(F.col("items"), b * rows + r) for r in range(rows)]) for b in range(bands)]
    return sets.filter(F.size("items") > 0).select("id", F.explode(F.array_distinct(F.array(*values))).alias("band"))


def candidates(left: DataFrame, right: DataFrame, bands: int = BANDS, rows: int = ROWS, most: int = MOST_PAIRS) -> DataFrame:
    """(a, b): pairs that share a band value, each once.

    A value with more than ``most`` pairs is hot: there every left id meets the smallest right id and every right id the smallest left one, so that the
    pairs of a value grow with its members and not with their product. Two sets that meet in hot values only are then found through these ids alone."""
    l, r = cut(banded(left, bands, rows), "bands").toDF("a", "band"), cut(banded(right, bands, rows), "bands").toDF("b", "band")
    sizes = l.groupBy("band").agg(F.count("*").alias("n"), F.min("a").alias("pivot_a")).join(r.groupBy("band").agg(F.count("*").alias("m"), F.min("b").alias("pivot_b")), "band")
    sizes = cut(sizes, "band_sizes")
    cold, hot = sizes.filter(F.col("n") * F.col("m") <= most).select("band"), sizes.filter(F.col("n") * F.col("m") > most)
    whole = l.join(cold, "band").join(r, "band").select("a", "b")
    stars = l.join(hot, "band").select("a", F.col("pivot_b").alias("b")).union(r.join(hot, "band").select(F.col("pivot_a").alias("a"), "b"))
    return whole.union(stars).distinct()


def similarity_join(left: DataFrame, right: DataFrame, least: float, bands: int = BANDS, rows: int = ROWS, most: int = MOST_PAIRS) -> DataFrame:
    """(a, b, similarity) of the candidate pairs of (id, items) sets whose Jaccard similarity is at least ``least``.

    ``items`` is an array without repeats; empty and null sets match nothing. Every pair is verified once, on the whole sets."""
    pairs = candidates(left, right, bands, rows, most)
    found = pairs.join(left.select(F.col("id").alias("a"), F.col("items").alias("_x")), "a").join(right.select(F.col("id").alias("b"), F.col("items").alias("_y")), "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    return found.withColumn("similarity", shared / (F.size("_x") + F.size("_y") - shared)).filter(F.col("similarity") >= least).select("a", "b", "similarity")
