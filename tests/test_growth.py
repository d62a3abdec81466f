"""What a task holds and what is shuffled follows the input: one test for every query that a review named, on rows of its own."""

import math
import random
import re
import statistics
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import feature as X, regression as R, stat as S
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from joulemill import storage
from joulemill.operators.exact import parts, piece_sums
from joulemill.plans import learning, workloads
from joulemill.plans.learning import pooled, spearman
from joulemill.registry import load
from joulemill.storage import bucket_number
from joulemill.streaming.queries import gradient_sums


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with the smallest tables, where single ones can be replaced by rows of the test."""
    def replaced(folder, **rows):
        for path in Path(folder).glob("*.parquet"):
            if path.stem not in rows:
                (tmp_path / path.name).symlink_to(path)
        for name, df in rows.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return replaced


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def orders(spark, n):
    day = F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    return spark.range(n).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") % 11 > 0, F.col("id") % 37).alias("o_custkey"), F.when(F.col("id") % 7 > 0, "F").alias("o_orderstatus"),
        F.col("id").cast("double").alias("o_totalprice"), day.alias("o_orderdate"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")).alias("o_orderpriority"))


def test_sketches_stand_beside_distinct_counts(spark, folder, tables):
    """No aggregate that is keyed by customer carries a sketch; null priorities meet theirs."""
    at = tables(folder, orders=orders(spark, 400))
    for name in ("agg_2_distinct", "rd_05_approximate"):
        lines = [x for x in plan(load()[name](spark, at)).splitlines() if "Aggregate" in x and "approx_count_distinct" in x]
        assert lines and not any("o_custkey" in re.search(r"keys=\[(.*?)\]", x)[1] for x in lines), name
    got = {r["o_orderpriority"]: (r["d"], r["sd"], r["pairs"], r["near"]) for r in load()["agg_2_distinct"](spark, at).collect()}
    rows = [(str(i % 3) if i % 5 else None, i % 37 if i % 11 else None, "F" if i % 7 else None) for i in range(400)]
    for p in (None, "0", "1", "2"):
        held = {(c, s) for q, c, s in rows if q == p}
        customers = {c for c, _ in held if c is not None}
        assert got[p] == (len(customers), sum(customers), sum(c is not None and s is not None for c, s in held), True)


def test_group_aggregates_keep_their_shapes_apart(spark, folder, tables):
    """Distinct parts multiply nothing else; nulls, repeated rows and a group without quantities."""
    draw = random.Random(6)
    rows = [(draw.randrange(40), draw.randrange(9), draw.choice([1, 2, 3, None]), draw.randrange(4), draw.choice([None, 1.0, 2.5, 7.0, 50.0]), draw.random()) for _ in range(400)]
    rows += rows[:50] + [(i, 1, 9, 1, None, 1.0) for i in range(4)] + [(1, 1, 8, 1, 2.0, 1.0)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    df = load()["ps_15_group_aggregates"](spark, tables(folder, lineitem=spark.createDataFrame(rows, schema)))
    aggregates = [x for x in plan(df).splitlines() if "Aggregate(" in x]
    assert not any("l_partkey" in re.search(r"keys?=\[(.*?)\]", x)[1] and re.search(r"percentile|median|min_by|avg", x) for x in aggregates)
    got = {r["l_suppkey"]: r.asDict() for r in df.collect()}
    assert set(got) == {1, 2, 3, 9}  # no null key, and three lines at least
    for s, g in got.items():
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (r[0], r[3], r[1], r[5]))
        q = [r[4] for r in mine if r[4] is not None]
        assert (g["n"], g["first"], g["nth"], g["last"], g["nunique"]) == (len(mine), mine[0][0], mine[2][0], mine[-1][0], len({r[1] for r in mine}))
        assert (g["idxmax"], g["idxmin"]) == (max(mine, key=lambda r: (r[5], r[0]))[0], min(mine, key=lambda r: (r[5], r[0]))[0])
        if not q:
            assert g["mean"] is g["mad"] is g["median"] is g["std"] is None
            continue
        m = statistics.fmean(q)
        assert g["median"] == statistics.median(q) and g["mad"] == pytest.approx(statistics.fmean(abs(x - m) for x in q), abs=1e-6)
        assert g["mean"] == pytest.approx(m, abs=1e-6) and g["std"] == pytest.approx(statistics.stdev(q), abs=1e-6)


def test_buckets_follow_the_rows(spark, folder, tables, monkeypatch):
    """Rows that compress to next to nothing still take their place in memory."""
    monkeypatch.setattr(storage, "TASK_BYTES", 100_000, raising=False)
    at = tables(folder, orders=orders(spark, 20_000).withColumn("o_orderkey", F.lit(1).cast("long")).coalesce(1))
    kept = spark.read.parquet(f"{at}/orders.parquet").select("o_orderkey", "o_custkey")
    assert storage.estimated_bytes(kept) < 500_000 and bucket_number(kept) == 16
    seen = []
    monkeypatch.setattr("joulemill.operators.layout.bucket_number", lambda *a: seen.append(bucket_number(*a)) or seen[-1])
    load()["lay_t_partition_transforms"](spark, at)
    assert seen == [16]


def test_xpath_rows_are_dealt_out(spark, folder, tables):
    """A table of one file is parsed by several tasks."""
    p = spark.range(25_000).select(F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") / 4).alias("p_retailprice"))
    at = tables(folder, part=p.coalesce(1))
    df = load()["xml_1_xpath"](spark, at)
    assert df.rdd.getNumPartitions() == 3
    got = df.agg(F.count("*"), F.sum("size"), F.sum("price"), F.bool_and("same"), F.sum(F.col("big").cast("int"))).first()
    assert tuple(got) == (25_000, 500 * sum(range(50)), sum(round(i / 4, 2) for i in range(25_000)), True, 500 * 24)


def test_waiting_suppliers_are_dealt_by_size(spark, folder, monkeypatch):
    monkeypatch.setattr(storage, "TASK_BYTES", 10_000, raising=False)
    parts = re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(load()["tpch_21_waiting_suppliers"](spark, folder)))
    assert parts and int(parts[0]) > 20


def test_gradient_sums_are_exact_at_any_partitioning(spark):
    draw = random.Random(7)
    rows = [(draw.uniform(-2, 2), draw.uniform(-1, 1) * 10.0 ** draw.randint(-9, 9), float(draw.random() < 0.5)) for _ in range(3000)]
    df, w = spark.createDataFrame(rows, "x double, y double, z double"), {"linear": (0.3, -1.7), "logistic": (0.1, 0.9)}
    seen = {tuple(gradient_sums(df.repartition(n), w)) for n in (1, 3, 17)}
    assert len(seen) == 1
    got = seen.pop()
    miss = [Fraction(0.3 + -1.7 * x - y) for x, y, _ in rows]
    assert got[0] == 3000 and got[1] == pytest.approx(float(sum(miss)), rel=1e-15)
    assert got[2] == pytest.approx(float(sum(Fraction(float(m) * x) for m, (x, _, _) in zip(miss, rows))), rel=1e-15)
    assert got[3] == pytest.approx(sum(1 / (1 + math.exp(-(0.1 + 0.9 * x))) - z for x, _, z in rows), abs=1e-9)
    assert gradient_sums(df.limit(0), w) == [0]


def test_pieces_of_arrays_are_those_of_columns(spark):
    values = [0.1, -0.0, 1e29, -1e29, 5e-324, -3.75, 2.0**62, -(2.0**40) - 0.5, 1e300, float("inf")]
    sums = spark.createDataFrame([(v,) for v in values], "x double").agg(*[F.sum(p) for p in parts(F.col("x"))]).first()
    assert piece_sums(np.array(values)) == [*map(int, sums[:4]), sums[4]]


def test_rank_correlation_is_the_built_in_one(spark):
    """Ties at their mean rank, repeated rows, one value for all in a column beside."""
    draw = random.Random(8)
    df = spark.createDataFrame([(float(draw.randrange(6)), draw.choice([-1.0, 0.5]) * draw.randrange(40)) for _ in range(500)], "a double, b double")
    want = S.Correlation.corr(X.VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df), "v", "spearman").first()[0].toArray()[0, 1]
    assert spearman(df, "a", "b") == pytest.approx(want, abs=1e-12)
    assert spearman(df.select("a", (-F.col("a")).alias("b")), "a", "b") == pytest.approx(-1)


def test_vocabulary_holds_every_word_and_vectors_take_several_tasks(spark, folder, tables, monkeypatch):
    tasks, fit = [], X.Word2Vec.fit
    monkeypatch.setattr(learning, "TEXT_CHARS", 1 << 19)
    monkeypatch.setattr(X.Word2Vec, "fit", lambda self, df: tasks.append(self.getNumPartitions()) or fit(self, df))
    own = F.concat_ws(" ", F.transform(F.sequence(F.col("id") * 900, F.col("id") * 900 + 899), lambda x: F.concat(F.lit("w"), x)))
    rows = spark.range(300).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("The house and the "), own).alias("text"))
    found = load()["ml_01_text_features"](spark, tables(folder, conversations=rows)).collect()  # 270,003 words, more than the built-in vocabulary takes unless told
    assert len(found) == 300 and all((r["words"], r["bigrams"], r["kept"], r["terms"], r["same"]) == (904, 903, 901, 903, True) for r in found)
    assert tasks == [math.ceil(sum(len(r["text"]) for r in rows.collect()) / (1 << 19))] and tasks[0] > 1


def test_entries_of_vectors_are_counted_as_stored(spark):
    vectors = [Vectors.sparse(1 << 30, {1: 0.0, 7: 2.0, 9: -1.0}), Vectors.sparse(4, {}), Vectors.dense([0.0, 1.0, float("nan")]), Vectors.dense([])]
    df = spark.createDataFrame(list(enumerate(vectors)), ["i", "v"])
    assert [r["n"] for r in df.orderBy("i").select(learning.size("v").alias("n")).collect()] == [2, 0, 2, 0]


def test_isotonic_fit_takes_a_row_for_each_value(spark, folder, monkeypatch):
    draw = random.Random(4)
    rows = [(float(x), draw.random(), x * 3.0 + draw.gauss(0, 20)) for x in (draw.choice([0, 1, 1, 1, 5, 8, 13, 40]) for _ in range(400))] + [(-draw.random(), 0.0, draw.random()) for _ in range(30)]
    d = X.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double"))
    plain, got = R.IsotonicRegression(featureIndex=0).fit(d), R.IsotonicRegression(featureIndex=0, weightCol="weight").fit(pooled(d))
    assert pooled(d).count() == len({a for a, _, _ in rows})
    assert list(got.boundaries) == list(plain.boundaries) and list(got.predictions) == pytest.approx(list(plain.predictions), rel=1e-12)

    taken, fit = [], R.IsotonicRegression.fit
    monkeypatch.setattr(R.IsotonicRegression, "fit", lambda self, df: taken.append((df.count(), df.agg(F.sum("weight")).first()[0])) or fit(self, df))
    assert load()["ml_07_regression"](spark, folder).count() == 8
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert taken == [(items.select("l_quantity").distinct().count(), items.count())]


def lloyd(x, k):
    """(centres, rounds) of k-means by the book."""
    c, rounds = x[:k].copy(), 0
    while True:
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
        c, was, rounds = new, c, rounds + 1
        if np.allclose(c, was, rtol=0, atol=1e-12):
            return c, rounds


def test_centres_settle_after_any_number_of_rounds(spark):
    x = np.arange(4000, dtype=float)[:, None]
    want, rounds = lloyd(x, 40)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert rounds > 1000 and np.allclose(workloads.kmeans(df, 40, tolerance=0.0), want, atol=1e-9)
    with pytest.raises(RuntimeError, match="still move"):
        workloads.kmeans(df, 40, tolerance=0.0, most=1000)
    with pytest.raises(RuntimeError, match="no numbers"):
        workloads.kmeans(df.limit(5).union(spark.createDataFrame([(9, [float("nan")])], df.schema)), 2, tolerance=0.0)


@pytest.mark.parametrize("points_at_the_edge, odd", ((0, True), (60, True), (60, False), (10**6, True)))
def test_centres_are_the_same_with_few_points_at_the_edge(spark, monkeypatch, points_at_the_edge, odd):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1000, 3))
    if odd:
        x = np.concatenate([x[:700], np.round(x[700:]), draw.normal(size=(20, 3)) * 1e30 ** (draw.random((20, 1)) < 0.1)])
        x[3] = x[1]  # two starts in one place: one of them keeps no point
    monkeypatch.setattr(workloads, "EDGE_BYTES", 8 * 3 * points_at_the_edge)
    passes, added = [], workloads.added
    monkeypatch.setattr(workloads, "added", lambda a: passes.append(1) or added(a))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    want, rounds = lloyd(x, 6)
    assert np.allclose(workloads.kmeans(df, 6, tolerance=0.0), want, rtol=1e-9)
    assert len(passes) <= rounds and (odd or len(passes) < rounds) and (len(passes) == 1 or points_at_the_edge < 10**6)


def test_rows_of_lists(spark):
    for rows in ([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [[1.0, None], [3.0, 4.0]]):
        column = pa.array([[0.0]] + rows, pa.list_(pa.float32()))[1:]
        assert np.array_equal(workloads.rows_of(column), np.array(rows, dtype=float), equal_nan=True)
    for rows in ([[1.0], [1.0, 2.0]], [[1.0], None]):
        with pytest.raises(Exception):
            workloads.rows_of(pa.array(rows, pa.list_(pa.float64())))
    for x in (np.array([[0.1, 2.0]]), np.array([[0.5, 1e300]]), np.array([[0.25, -3.0]])):
        assert (workloads.unpacked(workloads.packed(x), 1, 2) == x).all()
