"""Sharding: contiguous shards of nearly equal bytes.

Rows are put in one global order, range-partitioned and written; byte totals per partition give every partition its offset, running sums
inside the partition give every row its place, and the line of all bytes is cut at equal targets. The order is the hash of the text,
so copies of one text lie side by side, with the large groups of copies in front; a cut that would fall inside a group of copies moves to
the nearer edge of the group, unless that is further than a small share of a shard: equal sizes come first, and the group is split there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from joulemill.llm.registry import query, table
from joulemill.storage import cut

SHARDS = 8
SHIFT = 0.05  # of a shard; a cut moves no further to keep a group of copies in one piece
LARGE = 1024  # a group with more than one LARGE-th of the bytes or rows goes in front; so there are fewer than 2 * LARGE of them


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, _g, _front) range-partitioned in the global order, written, with the partition as ``_p``."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = cut(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_g")), "sizes")
    groups = rows.groupBy("_g").agg(F.sum("size").alias("_front"), F.count("*").alias("_n"))
    total = rows.agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    large = groups.join(F.broadcast(total), (F.col("_n") > 1) & ((F.col("_front") * LARGE > F.col("_bytes")) | (F.col("_n") * LARGE > F.col("_rows")))).select("_g", "_front")
    marked = rows.join(F.broadcast(large), "_g", "left").fillna(0, ["_front"])
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.desc("_front"), F.asc("_g"), F.asc_nulls_last("doc_id")]
    return cut(marked.repartitionByRange(tasks, *key).withColumn("_p", F.spark_partition_id()), "ordered")


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``_at`` (bytes before the row) and ``_row`` (rows before it) in the global order."""
    parts = rows.groupBy("_p").agg(F.sum("size").alias("_b"), F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = parts.select("_p", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"))
    inside = Window.partitionBy("_p").orderBy(F.desc("_front"), F.asc("_g"), F.asc_nulls_last("doc_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = rows.join(F.broadcast(offsets), "_p")
    return df.withColumn("_at", F.col("_b0") + F.sum("size").over(inside) - F.col("size")).withColumn("_row", F.col("_c0") + F.count("*").over(inside) - 1).drop("_b0", "_c0", "_p")


def cuts(rows: DataFrame, shards: int) -> list[int]:
    """Byte positions where shards 1, 2, ... begin: equal targets, moved to the nearer edge of a group of copies where that is near. Only the groups at a
    target, at most one for each cut, reach the driver."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    marks = [total * k / shards for k in range(1, shards)]
    if not total or not marks:
        return marks
    at_mark = [(F.col("_at") < m) & (F.col("_at") + F.col("size") > m) for m in marks]
    hit = at_mark[0]
    for x in at_mark[1:]:
        hit = hit | x
    struck = rows.filter(hit).select("_g").distinct()
    spans = [tuple(r) for r in rows.join(F.broadcast(struck), "_g").groupBy("_g").agg(F.min("_at"), F.max(F.col("_at") + F.col("size"))).select("min(_at)", "max((_at + size))").collect()]
    rows_hit = [tuple(r) for r in rows.filter(hit).select("_at", F.col("_at") + F.col("size")).collect()]
    edges = lambda pieces, m: min((e for p in pieces if p[0] < m < p[1] for e in p), key=lambda e: abs(e - m), default=m)
    found = []
    for m in marks:
        edge = edges(spans, m)
        found.append(int(edge if abs(edge - m) * shards <= SHIFT * total else edges(rows_hit, m)))
    return sorted(found)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``; ``size`` is the bytes of the text plus one.

    A null text counts as empty; a long one is measured whole and never cut; rows of size 1 are ordered and dealt out like others, repeated rows and ids each get a slot of their
    own, and with fewer groups than shards some shards stay empty. Only ids, sizes and hashes are shuffled, never texts."""
    rows = cut(placed(ordered(docs)), "placed")
    number = F.lit(0)
    for c in cuts(rows, shards):
        number = number + (F.col("_at") >= c).cast("int")
    rows = rows.withColumn("shard", number)
    first = rows.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row per shard
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    df = shard(table(spark, folder, "documents"))
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
