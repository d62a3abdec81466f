"""The distributed forms of order-sensitive operators give the rows of the plain windows (forced by tiny bounds)."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from joulemill.frames import ops
from joulemill.operators import ordered
from joulemill.operators.temporal import asof_join, points_in_spans, salted_join, salted_totals

def order():
    return [F.col("t"), F.col("id")]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(600):
        key = "hot" if i % 3 else rnd.choice(["a", "b", None])
        data.append((i, key, rnd.randrange(200), None if i % 7 == 0 else float(rnd.randrange(-20, 60)) / 4))
    return spark.createDataFrame(data, "id long, k string, t long, v double")


def same(a, b):
    norm = lambda df: sorted(tuple("null" if x is None else (f"{x + 0.0:.9g}" if isinstance(x, float) else str(x)) for x in r) for r in df.select(*sorted(df.columns)).collect())
    assert norm(a) == norm(b)


@pytest.mark.parametrize("keys", [["k"], []])
def test_positions(rows, keys):
    same(ordered.positions(rows, keys, order(), group_rows=50), ordered.positions(rows, keys, order()))


def test_running(rows):
    aggs = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "last": ("last", F.col("v")), "first": ("first", F.col("v"))}
    same(ordered.running(rows, ["k"], order(), aggs, group_rows=50), ordered.running(rows, ["k"], order(), aggs))
    same(ordered.running(rows, [], order(), aggs, group_rows=50), ordered.running(rows, [], order(), aggs))


def test_framed(rows):
    exprs = {"s": lambda w, _: F.sum("v").over(w), "p": lambda _, w: F.lag("v", 3).over(w), "n": lambda _, w: F.lead("v", 2).over(w)}
    same(ordered.framed(rows, ["k"], order(), 3, 2, exprs, group_rows=40), ordered.framed(rows, ["k"], order(), 3, 2, exprs))


def test_ranks(rows):
    same(ordered.ranks(rows, ["k"], "t", "id", group_rows=50), ordered.ranks(rows, ["k"], "t", "id"))
    same(ordered.ranks(rows, ["k"], "t", "id", descending=True, group_rows=50), ordered.ranks(rows, ["k"], "t", "id", descending=True))


def test_percentiles(rows):
    got = {r["k"]: (r["a"], r["b"]) for r in ordered.percentiles(rows, ["k"], "v", {"a": 0.5, "b": 0.9}, group_rows=20).collect()}
    pdf = rows.toPandas().dropna(subset=["v"])
    for k, g in pdf.groupby("k", dropna=False):
        k = None if pd.isna(k) else k
        assert got[k] == pytest.approx((g["v"].quantile(0.5), g["v"].quantile(0.9)))


def test_one_per_key(rows):
    got = ordered.one_per_key(rows, ["k"], [F.col("t"), F.col("id")])
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "id"))).filter("n = 1").drop("n")
    same(got, want)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_join(spark, direction, exact):
    rnd = random.Random(3)
    times = sorted(rnd.sample(range(5000), 240))
    left = pd.DataFrame({"ts": pd.to_datetime(times[::2] + times[1:20:2], unit="s"), "k": [rnd.choice("ab") for _ in range(130)]}).sort_values("ts").reset_index(drop=True)
    left["id"] = range(len(left))
    right = pd.DataFrame({"ts": pd.to_datetime(times[1::2], unit="s"), "k": [rnd.choice("ab") for _ in range(120)]})
    right["v"] = [float(i) for i in range(len(right))]
    want = pd.merge_asof(left, right, on="ts", by="k", direction=direction, allow_exact_matches=exact, tolerance=pd.Timedelta("60s"))
    want = {r.id: None if pd.isna(r.v) else r.v for r in want.itertuples()}
    l, r = spark.createDataFrame(left), spark.createDataFrame(right)
    for bound in (ordered.GROUP_ROWS, 30):
        got = asof_join(l, r, "ts", ["k"], ["v"], direction=direction, allow_exact_matches=exact, tolerance_s=60, group_rows=bound)
        assert {x["id"]: x["v"] for x in got.collect()} == want


def test_points_in_spans(spark):
    rnd = random.Random(1)
    spans = [(i, a := rnd.randrange(1000), a + rnd.choice([0, 1, 5, 300])) for i in range(60)]
    points = [(i, rnd.randrange(1100)) for i in range(200)]
    got = points_in_spans(spark.createDataFrame(points, "p long, x long"), spark.createDataFrame(spans, "s long, lo long, hi long"), "x", "lo", "hi")
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted((p, s) for p, x in points for s, lo, hi in spans if lo <= x <= hi)


def test_salting(spark, rows):
    small = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, w int")
    same(salted_join(rows, small, "k", hot_rows=100), rows.join(small, "k"))
    same(salted_totals(rows, ["k"], ["t"]), rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("t").alias("t")))


def test_frame_operators_on_hot_keys(rows):
    for bound in (ordered.GROUP_ROWS, 40):
        pdf = rows.toPandas().sort_values(["t", "id"])
        got = ops.ewm_mean(rows, ["k"], order(), "v", "e", 0.3, group_rows=bound).toPandas().set_index("id")["e"]
        roll = ops.rolling(rows, ["k"], order(), "v", 5, {"m": "mean"}, min_periods=2, group_rows=bound).toPandas().set_index("id")["m"]
        exp = ops.expanding(rows, ["k"], order(), "v", {"x": "var"}, min_periods=2, group_rows=bound).toPandas().set_index("id")["x"]
        fill = ops.fill(rows, ["k"], [("t", True), ("id", True)], "v", group_rows=bound).toPandas().set_index("id")
        for _, g in pdf.groupby("k", dropna=False):
            ids = g["id"]
            pd.testing.assert_series_equal(got[ids].reset_index(drop=True), g["v"].ewm(alpha=0.3).mean().reset_index(drop=True), check_names=False)
            pd.testing.assert_series_equal(roll[ids].reset_index(drop=True), g["v"].rolling(5, min_periods=2).mean().reset_index(drop=True), check_names=False)
            pd.testing.assert_series_equal(exp[ids].reset_index(drop=True), g["v"].expanding(2).var().reset_index(drop=True), check_names=False)
            pd.testing.assert_series_equal(fill["ffill"][ids].reset_index(drop=True), g["v"].ffill().reset_index(drop=True), check_names=False)
            pd.testing.assert_series_equal(fill["bfill"][ids].reset_index(drop=True), g["v"].bfill().reset_index(drop=True), check_names=False)
            pd.testing.assert_series_equal(fill["interpolate"][ids].reset_index(drop=True), g["v"].interpolate().reset_index(drop=True), check_names=False)


def test_kendall_by_brute_force(spark):
    rnd = random.Random(9)
    xy = [(rnd.randrange(12), rnd.randrange(9)) for _ in range(120)]
    got = ops.kendall(spark.createDataFrame(xy, "x int, y int"), "x", "y", group_rows=25).first()[0]
    con = dis = tx = ty = 0
    for i in range(len(xy)):
        for j in range(i):
            dx, dy = xy[i][0] - xy[j][0], xy[i][1] - xy[j][1]
            con, dis = con + (dx * dy > 0), dis + (dx * dy < 0)
            tx, ty = tx + (dx == 0), ty + (dy == 0)
    pairs = len(xy) * (len(xy) - 1) / 2
    assert got == pytest.approx((con - dis) / ((pairs - tx) * (pairs - ty)) ** 0.5)


def test_resample_edges(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", 2.0), ("a", "2024-01-01 03:30:00", 4.0)], "k string, t string, v double").withColumn("ts", F.to_timestamp("t"))
    left = {str(r["bin"]): r["sum"] for r in ops.resample(df, ["k"], "ts", "v", 3600).collect()}
    right = {str(r["bin"]): r["sum"] for r in ops.resample(df, ["k"], "ts", "v", 3600, "right", "right").collect()}
    assert left == {"2024-01-01 00:00:00": 1.0, "2024-01-01 01:00:00": 2.0, "2024-01-01 02:00:00": 0.0, "2024-01-01 03:00:00": 4.0}
    assert right == {"2024-01-01 00:00:00": 1.0, "2024-01-01 01:00:00": 2.0, "2024-01-01 02:00:00": 0.0, "2024-01-01 03:00:00": 0.0, "2024-01-01 04:00:00": 4.0}


def test_points_in_spans_at_cell_borders(spark):
    """Lengths around powers of two, zero and the scale of microseconds: the float logarithm must not lose a cell."""
    spans = [(0, 2**31 - 1, 2**32), (1, 7, 7), (2, 10**15, 10**15 + 10**12)]
    spans += [(10 * k + d + 5, start, start + 2**k + d) for k in (0, 1, 5, 20, 31, 40) for d in (-1, 0, 1) for start in (0, 3, 2**k - 1)]
    points = sorted({p for _, lo, hi in spans for p in (lo - 1, lo, lo + 1, (lo + hi) // 2, hi - 1, hi, hi + 1)} | {2**31 + 5, 2**32 - 7})
    for base in (1, 3_600):
        got = points_in_spans(spark.createDataFrame([(p,) for p in points], "x long"), spark.createDataFrame(spans, "s long, lo long, hi long"), "x", "lo", "hi", base=base)
        want = sorted((p, s, lo, hi) for p in points for s, lo, hi in spans if lo <= p <= hi)
        assert sorted((r["x"], r["s"], r["lo"], r["hi"]) for r in got.collect()) == want


def test_salted_join_kinds(spark):
    rows = spark.createDataFrame([(7, i) for i in range(300)] + [(i, i) for i in range(20)] + [(None, i) for i in range(50)], "k long, v long")
    small = spark.createDataFrame([(7, "a"), (3, "b"), (99, "c"), (None, "d")], "k long, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        same(salted_join(rows, small, "k", hot_rows=100, how=how), rows.join(small, "k", how))
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            salted_join(rows, small, "k", hot_rows=100, how=how)
