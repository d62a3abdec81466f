"""Streams over several arrivals: state, late rows, restarts, and the pinned session example."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from joulemill.storage import scratch
from joulemill.streaming import sessions
from joulemill.streaming.queries import student_p, welch
from joulemill.streaming.run import drain, drain_batches, upserted


def arrivals(spark, batches, schema):
    """One JSON file per batch, read one file at a time in name order."""
    path = scratch(spark, "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/b={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/*")


def events(spark, batches):
    s = arrivals(spark, batches, "user_id long, event_id long, sec long, event_type string")
    return s.withColumn("ts", F.timestamp_seconds("sec"))


def test_two_condition_sessions(spark):
    # user, second: two events out of order and a close, a gap session, a lone event; the last stays open
    rows = [(1, 13, "NEW"), (1, 10, "NEW"), (1, 15, "CLOSE"), (1, 17, "NEW"), (1, 19, "NEW"), (1, 29, "NEW"), (2, 45, "NEW"), (1, 65, "NEW")]
    batch = [(u, i, s, k) for i, (u, s, k) in enumerate(rows)]
    for batches in ([batch], [batch[:2], batch[2:5], batch[5:]]):
        out = sessions.two_condition_sessions(events(spark, batches), 5_000_000, 10_000_000, "CLOSE")
        got = sorted((r["user_id"], r["end_us"] - r["start_us"], r["n"]) for r in out.collect())
        assert got == [(1, 5_000_000, 1), (1, 5_000_000, 3), (1, 7_000_000, 2), (2, 5_000_000, 1)]


def test_gap_sessions_across_batches(spark):
    stream = events(spark, [[(1, 1, 100, "x"), (1, 2, 104, "x")], [(1, 3, 108, "x"), (2, 4, 109, "x")], [(1, 5, 200, "x")], [(9, 6, 400, "end")]])
    got = sorted(tuple(r) for r in drain(sessions.gap_sessions(stream, "user_id", 10_000, "10 seconds")).collect())
    assert got == [(1, 100_000, 108_000, 3), (1, 200_000, 200_000, 1), (2, 109_000, 109_000, 1)]


def test_late_rows_and_duplicates(spark):
    stream = events(spark, [[(1, 1, 100, "a"), (1, 1, 101, "a")], [(1, 2, 500, "a")], [(1, 3, 600, "a")], [(1, 4, 90, "late")]]).withWatermark("ts", "10 seconds")
    got = drain(stream.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"))
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3]


def test_upsert_keeps_the_newest(spark):
    stream = events(spark, [[(1, 1, 1, "a")], [(1, 2, 2, "a"), (2, 3, 3, "a")], [(1, 4, 4, "a")]])
    got = upserted(stream.groupBy("user_id").agg(F.count("*").alias("n")), ["user_id"])
    assert {r["user_id"]: r["n"] for r in got.collect()} == {1: 3, 2: 1}


def test_batches_have_numbers(spark):
    stream = events(spark, [[(1, 1, 1, "a")], [(1, 2, 2, "b")]])
    got = drain_batches(stream.select("event_id"), "append")
    assert sorted((r["batch"], r["event_id"]) for r in got.collect()) == [(0, 1), (1, 2)]


def test_student_p_and_welch(spark):
    for t_value, df in ((2.0, 10), (0.5, 30), (0.05, 4), (4.0, 3)):
        xs = np.linspace(-t_value, t_value, 200_001)
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        inside = np.trapezoid(scale * (1 + xs * xs / df) ** (-(df + 1) / 2), xs)
        assert student_p(t_value, df) == pytest.approx(1 - inside, abs=1e-8)
    assert student_p(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    s = arrivals(spark, [[(0, 900.0), (1, -900.0)], [(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0), (1, 6.0), (1, 8.0)]], "user_id long, value double")
    r = welch(s, peace=1, window=5).first()  # the first batch falls into the peace period
    assert (r["n"], r["t"], r["df"]) == (6, pytest.approx(-3.098387, abs=1e-5), pytest.approx(2.941, abs=1e-3))


def test_significance_takes_every_batch(spark, monkeypatch):
    from joulemill.streaming import queries

    rows = spark.createDataFrame([(b, arm, 10, 5.0 * arm + b, 40.0) for b in range(15) for arm in (0, 1)], "batch long, arm long, n long, s double, q double")
    monkeypatch.setattr(queries, "table_stream", lambda t, name: None)
    monkeypatch.setattr(queries, "drain_batches", lambda *_: rows)
    assert queries.significance(None).first()["n"] == 300 and queries.welch(None, 0, 10).first()["n"] == 200


def test_windows_by_inverse_equal_recomputation(spark):
    """Several batches, gaps longer than a window, a key without new rows, sums that would drift if floats were taken back."""
    from collections import defaultdict

    from joulemill.streaming.panes import window_reduce

    rng = np.random.default_rng(1)
    rows = sorted((int(s), int(k), float(v)) for s, k, v in zip(rng.integers(0, 3000, 300), rng.integers(0, 3, 300), rng.normal(size=300) * 10.0 ** rng.integers(-3, 8, 300)))
    rows += [(9000, 1, 0.1), (9001, 1, 0.2), (9500, 2, 1e9)]
    batches = [[(k, s, v) for s, k, v in rows[i : i + 60]] for i in range(0, len(rows), 60)] + [[(-1, 100_000, 0.0)]]
    s = arrivals(spark, batches, "k long, sec long, x double").withColumn("ts", F.timestamp_seconds("sec"))
    out = drain(window_reduce(s, "0 seconds", ["k"], {"total": F.col("x")}, 300_000, 100_000)).filter("k >= 0")
    got = {(r["k"], int(r["start"].timestamp())): (r["n"], r["total"]) for r in out.select("k", F.col("start"), "n", "total").collect()}
    want = defaultdict(list)
    for sec, k, v in rows:
        for i in range(3):
            want[k, sec // 100 * 100 - 100 * i].append(v)
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(math.fsum(v), rel=1e-14, abs=1e-20) for k, v in want.items())
    with pytest.raises(ValueError):
        window_reduce(s, "0 seconds", ["k"], {}, 250_000, 100_000)


def test_models_go_on_and_repeat(spark):
    """Stop, restart and replay: versions of a model depend on their batch and the version before, and on nothing that a driver held."""
    from joulemill.streaming.models import learned, version
    from joulemill.streaming.queries import first_centres, move_centres

    rng = np.random.default_rng(2)
    source, schema = scratch(spark, "vectors"), "vec_id long, embedding array<double>"
    batches = [[(b * 50 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 3)) + 3 * b)] for b in range(4)]

    def arrive(some):
        for b in some:
            spark.createDataFrame(batches[b], schema).coalesce(1).write.mode("append").json(f"{source}/b={b}")

    def run(root):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{source}/*")
        return learned(stream, first, move_centres, root)

    def model(root, number):
        return sorted((r["centre"], r["weight"], tuple(r["place"])) for r in version(spark, root, number, first.schema).collect())

    first = first_centres(spark.createDataFrame(batches[0], schema), 2)
    arrive([0, 1])
    root, last = run(scratch(spark, "model"))
    assert last == 1
    arrive([2, 3])
    assert run(root) == (root, 3)  # goes on with batches 2 and 3
    centres, weights = np.array([batches[0][i][1] for i in range(2)]), np.zeros(2)
    for b in range(4):
        x = np.array([v for _, v in batches[b]])
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in range(2):
            held, n = weights[c] * 0.9, (near == c).sum()
            if held + n:
                centres[c] = (centres[c] * held + x[near == c].sum(axis=0)) / (held + n)
            weights[c] = held + n
        got = model(root, b)
        assert np.allclose([g[2] for g in got], centres) and np.allclose([g[1] for g in got], weights)
    # a batch that runs a second time, after its model was written but before it was committed
    before = model(root, 3)
    batch = spark.read.schema(schema).json(f"{source}/b=3")
    move_centres(version(spark, root, 2, first.schema), batch).write.mode("overwrite").parquet(f"{root}/model/3")
    assert model(root, 3) == before
    other, last = run(scratch(spark, "model"))
    assert last == 3 and model(other, 3) == before


def test_timer_alone_closes_sessions(spark):
    from joulemill.streaming.run import drain_until_idle

    stream = events(spark, [[(1, 1, 100, "x"), (1, 2, 104, "x"), (2, 3, 100, "x")], [(1, 4, 500, "x"), (1, 5, 505, "x")]])
    got = sorted(tuple(r) for r in drain_until_idle(sessions.idle_sessions(stream, "user_id", 10_000, 60_000, 4_000), limit_s=120).collect())
    assert got == [(1, 100_000, 104_000, 2, False), (1, 500_000, 505_000, 2, True), (2, 100_000, 100_000, 1, True)]


def test_full_and_semi_stream_joins(spark):
    """Left rows without a match, right rows without one, and a left row with several matches from both directions in time."""
    def side(batches, names):
        s = arrivals(spark, batches, f"{names[0]} long, {names[1]} long, sec long")
        return s.select(names[0], names[1], F.timestamp_seconds("sec").alias(f"{names[1]}_ts")).withWatermark(f"{names[1]}_ts", "1 second")

    def sides():
        left = side([[(1, 7, 100), (2, 8, 100)], [(3, 7, 300)], [(-1, -1, 9000)]], ("a", "k"))
        right = side([[(10, 7, 95), (11, 7, 99)], [(12, 7, 100), (13, 9, 300)], [(-1, -1, 9000)]], ("b", "j"))
        return left, right, F.expr("k = j AND j_ts BETWEEN k_ts - INTERVAL 10 SECONDS AND k_ts")

    left, right, near = sides()
    full = {(r["a"], r["b"]) for r in drain(left.join(right, near, "full_outer").select("a", "b")).collect()}
    assert full - {(-1, -1)} == {(1, 10), (1, 11), (1, 12), (2, None), (3, None), (None, 13)}
    left, right, near = sides()
    assert [r["a"] for r in drain(left.join(right, near, "left_semi").select("a")).collect() if r["a"] > 0] == [1]


def test_triggers_are_checked(spark):
    writer = arrivals(spark, [[(1,)]], "x long").writeStream
    for wrong in ({"processingTime": ""}, {"processingTime": 5}, {"once": False}, {"availableNow": False}, {"continuous": ""}, {}, {"once": True, "availableNow": True}):
        with pytest.raises(Exception):
            writer.trigger(**wrong)
