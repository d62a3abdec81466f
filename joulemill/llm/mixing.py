"""Mixing sources to target weights.

Sizes are summed per source, targets come from the weights, and a source's repetition rate is target / size. Each document is
emitted floor(rate) times, plus once more when its draw, a hash of its id, falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from joulemill.llm.registry import query, table
from joulemill.llm.words import free_names, SQL_WORDS, word_count
from joulemill.storage import cut

WEIGHTS = (1, 2, 3)  # dealt to the sources in order, repeating
MOST = 3  # a target is at most so many times its source's size
SEED = "mix"


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1), fixed by id and seed: the first 32 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> the same with ``target`` and ``rate``.

    The level L with sum(min(most * size, L * weight)) = total is the largest of (total - caps of the first k) / (weights of the rest)
    over the sources ordered by cap / weight: no k can give more, and the right k gives exactly it. The windows hold one row per
    source, not per document."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    df = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    df = df.withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    df = df.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(rest))
    target = F.least(F.col("_cap").cast("double"), F.max("_level").over(everything) * F.col("_w"))
    df = df.withColumn("target", target)
    return df.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).select("source", "source_size", "target", "rate")


def counted(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    Null and empty texts have size 0 and a null source is a source of its own; a source of size 0 has target 0 and no copies. Rows with
    one id share one draw. The one join is on the source, null-safe; its small side has a row per source, so Spark broadcasts it below
    its size threshold and splits the hot source otherwise."""
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rates = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "rates").withColumnRenamed("source", "_s")
    df = sizes.join(rates, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    extra = (draw(F.col("doc_id")) < F.col("rate") - F.floor("rate")).cast("long")
    return df.select("doc_id", "source", "size", "source_size", "target", (F.floor("rate") + extra).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as their source's rate asks, all columns as they were, whatever their names. The texts are
    not shuffled: a row is repeated where it lies, by the rate of its source. A null source is one of its own."""
    s, r, n = free_names(docs.columns, "s", "rate", "n")
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "rates").select(F.col("source").alias(s), F.col("rate").alias(r))
    df = docs.join(rates, F.col("source").eqNullSafe(F.col(s)))
    copies = F.floor(r) + (draw(F.col("doc_id")) < F.col(r) - F.floor(r)).cast("long")
    return df.withColumn(n, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select([F.col(f"`{c}`") for c in docs.columns])


#: Sources and rates of a table ``mix_in`` (doc_id, source, size).
SQL_MIX = f"""
mix_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM mix_in GROUP BY source),
mix_weight AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS w, {MOST} * source_size AS cap FROM mix_source),
mix_level AS (SELECT *, ((SELECT sum(source_size) FROM mix_source)::BIGINT - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
  / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM mix_weight WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST)),
mix_target AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(lvl) FROM mix_level) * w) AS target FROM mix_level),
mix_rate AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM mix_target),
mix_taken AS (SELECT d.*, source_size, target, floor(rate)::BIGINT + (('0x' || left(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate))::BIGINT AS copies
  FROM mix_in d JOIN mix_rate r ON d.source IS NOT DISTINCT FROM r.source)"""


@query("op6_mixing", f"WITH mix_in AS (SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size FROM documents), {SQL_MIX} SELECT doc_id, size, source_size, target, size * copies AS taken FROM mix_taken")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return counted(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
