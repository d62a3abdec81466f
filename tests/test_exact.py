"""Order-independent sums, window reduce, data-sized layout, similarity bands and text wrapping."""

import math
import random
import textwrap
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from joulemill.frames.queries import wrapped
from joulemill.operators.aggregates import count_min_estimate
from joulemill.operators.exact import exact_avg, exact_sum
from joulemill.operators.ordered import running
from joulemill.plans import similarity
from joulemill.registry import load
from joulemill.storage import bucket_number, gathered, scratch, write_bucketed
from tests.harness import difference, duck, duck_table, spark_table


def test_sums_are_right_in_any_order(spark):
    draw = random.Random(1)
    values = [draw.choice([-1, 1]) * draw.random() * 10.0 ** draw.randint(-12, 12) for _ in range(4000)] + [0.1] * 50 + [-0.0, 1e29, -1e29, 5e-324]
    want = float(sum(map(Fraction, values)))
    seen = set()
    for parts in (1, 3, 17):
        draw.shuffle(values)
        df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "k int, x double").repartition(parts)
        seen.add(df.agg(exact_sum("x").alias("s")).first()["s"])
    assert len(seen) == 1 and seen.pop() == pytest.approx(want, rel=1e-15)


def test_sums_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("null", None), ("null", None), ("nan", nan), ("nan", 1.0), ("inf", inf), ("inf", 3.0), ("both", inf), ("both", -inf), ("huge", 1e300), ("huge", 1.0), ("some", None), ("some", 2.5)]
    got = {r["k"]: (r["s"], r["m"]) for r in spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(exact_sum("x").alias("s"), exact_avg("x").alias("m")).collect()}
    assert got["null"] == (None, None) and got["inf"][0] == inf and got["huge"][0] == 1e300 and got["some"] == (2.5, 2.5)
    assert math.isnan(got["nan"][0]) and math.isnan(got["both"][0])
    assert spark.createDataFrame([], "x double").agg(exact_sum("x").alias("s")).first()["s"] is None


def test_running_sums_agree_to_the_last_bit(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(i, i % 3, draw.uniform(-1, 1) * 10.0 ** draw.randint(-6, 6)) for i in range(3000)], "i long, k int, x double")
    plain = running(df, ["k"], [F.col("i")], {"s": ("sum", F.col("x"))})
    split = running(df, ["k"], [F.col("i")], {"s": ("sum", F.col("x"))}, group_rows=100)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


@pytest.mark.parametrize("partitions", [1, 8, 211])
def test_mean_of_run_totals_at_any_partitioning(spark, folder, partitions):
    q = load()["co_06_mean_total_carbon"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for _ in range(3):
            assert difference(spark_table(q(spark, folder)), duck_table(duck(folder), q.sql)) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def files(spark, path):
    return spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().count()


def test_files_follow_the_size(spark):
    """A hot value gets more files as the table grows, a rare one stays one file; buckets are sized by the estimate and one file each."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "200000")
    try:
        counts = {}
        for n in (20_000, 400_000):  # tasks that read grow with the table, and a value is split by them
            df = spark.range(0, n, 1, n // 10_000).select(F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
            path = scratch(spark, "layout")
            gathered(df, "k").write.partitionBy("k").parquet(path)
            assert spark.read.parquet(path).count() == n
            counts[n] = {k: files(spark, f"{path}/k={k}") for k in ("hot", "rare")}
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    assert counts[400_000]["hot"] > 3 * counts[20_000]["hot"] and counts[20_000]["rare"] == 1 and counts[400_000]["rare"] <= 6


def test_buckets_follow_the_size(spark):
    small, large = (spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")) for n in (1000, 100_000))
    assert bucket_number(small, target=16_000) == 1 and bucket_number(large, target=16_000) == 128 and bucket_number(small, large, target=16_000) == 128
    path = scratch(spark, "bucketed")
    table = write_bucketed(large, "t_" + path.rsplit("-", 1)[1], path, "k", bucket_number(large, target=200_000))
    assert files(spark, path) == 8 and table.count() == 100_000
    plan = table.join(table.withColumnRenamed("v", "w"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def brute_pairs(left, right, least):
    return {(a, b) for a, x in left for b, y in right if x and y and len(set(x) & set(y)) >= least * len(set(x) | set(y))}


def test_similarity_join_recall(spark):
    draw = random.Random(3)
    left = [(i, draw.sample(range(400), 30)) for i in range(300)]
    right = [(1000 + i, [v if draw.random() < 0.75 else draw.randrange(400, 800) for v in x]) for i, x in left[:200]] + [(5000, []), (5001, None)]
    right = [(i, list(dict.fromkeys(x)) if x is not None else None) for i, x in right]
    l, r = spark.createDataFrame(left, "id long, items array<long>"), spark.createDataFrame(right, "id long, items array<long>")
    got = {(x["a"], x["b"]) for x in similarity.similarity_join(l, r, 0.4).collect()}
    want = brute_pairs(left, [x for x in right if x[1]], 0.4)
    assert got <= want and len(got) >= 0.95 * len(want) > 50
    assert similarity.similarity_join(l.limit(0), r, 0.4).count() == 0


def test_candidates_on_one_hot_item_are_linear(spark):
    """All sets share the item whose hash is smallest, so they meet in every band; pairs grow with the sets, not with their square."""
    def number(n):
        df = spark.range(n).select("id", F.array(F.lit(7).cast("long")).alias("items"))
        return similarity.candidates(df, df, most=1000).count()

    assert number(1200) <= 2.2 * number(600) <= 2.2 * 2 * 600


@pytest.mark.parametrize("width", [1, 5, 12, 60])
def test_wrapped_lines(spark, width):
    draw = random.Random(4)
    texts = ["", "   ", "one", "a b c", "abcdefghijklmnopqrstuvwxyz", "ab cdefghijklmnop qr", " lead\tand\n\ntrail  "] + [" ".join("x" * draw.randint(1, 15) for _ in range(draw.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*texts, None])], "i int, s string")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", wrapped(F.col("s"), width).alias("a"), wrapped(F.col("s"), width, break_long=False).alias("b")).collect()}
    for i, s in enumerate(texts):
        want = lambda long: [line.strip() for line in textwrap.wrap(" ".join(s.split()), width, break_long_words=long, break_on_hyphens=False)]
        assert got[i] == (want(True), want(False)), s
    assert got[len(texts)] == (None, None)


def test_count_min_estimates_are_the_counters(spark):
    draw = random.Random(5)
    values = [int(draw.expovariate(0.02)) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    sketch = df.agg(F.count_min_sketch("x", F.lit(0.02), F.lit(0.9), F.lit(3)).alias("s"))
    true = Counter(values)
    asked = spark.createDataFrame([(v,) for v in [*true, 4_000_000_000]], "x long").crossJoin(sketch).select("x", count_min_estimate(F.col("s"), F.col("x")).alias("e"))
    over = [r["e"] - true[r["x"]] for r in asked.collect()]
    assert min(over) >= 0 and sum(o <= 0.02 * 5000 for o in over) >= 0.9 * len(over)
