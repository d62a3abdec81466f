"""Graph fixpoints against plain Python on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from joulemill.plans import graphs


def edges(spark, pairs, schema="src long, dst long"):
    return spark.createDataFrame(pairs, schema)


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(2)
    return [(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)]


def test_closure(spark, pairs):
    known = set(pairs)
    while True:
        grown = known | {(a, d) for a, b in known for c, d in pairs if b == c}
        if grown == known:
            break
        known = grown
    assert {tuple(r) for r in graphs.transitive_closure(edges(spark, pairs)).collect()} == known


def test_long_chain_is_compacted(spark):
    chain = [(i, i + 1) for i in range(14)]
    assert graphs.transitive_closure(edges(spark, chain)).count() == 14 * 15 // 2


def test_components(spark, pairs):
    label = {v: v for p in pairs for v in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    assert {r["id"]: r["component"] for r in graphs.connected_components(edges(spark, pairs)).collect()} == label


def test_components_of_a_star_and_a_chain(spark):
    star = [(0, i) for i in range(1, 30)] + [(100 + i, 101 + i) for i in range(25)]
    got = {r["id"]: r["component"] for r in graphs.connected_components(edges(spark, star)).collect()}
    assert all(c == (0 if v < 100 else 100) for v, c in got.items()) and len(got) == 56


def test_triangles(spark, pairs):
    und = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    vs = sorted({v for p in und for v in p})
    want = {}
    for i, a in enumerate(vs):
        for j in range(i + 1, len(vs)):
            for k in range(j + 1, len(vs)):
                b, c = vs[j], vs[k]
                if {(a, b), (a, c), (b, c)} <= und:
                    for v in (a, b, c):
                        want[v] = want.get(v, 0) + 1
    assert {r["id"]: r["triangles"] for r in graphs.triangles(edges(spark, pairs)).collect()} == want


def test_shortest_paths(spark, pairs):
    weighted = [(a, b, float((a + b) % 5 + 1)) for a, b in set(pairs)]
    start = pairs[0][0]
    dist = {start: 0.0}
    for _ in range(50):
        for a, b, w in weighted:
            if a in dist and dist[a] + w < dist.get(b, 1e9):
                dist[b] = dist[a] + w
    got = graphs.shortest_paths(edges(spark, weighted, "src long, dst long, w double"), start)
    assert {r["id"]: r["dist"] for r in got.collect()} == dist


def test_pagerank_settles(spark, pairs):
    a = {r["id"]: r["rank"] for r in graphs.pagerank(edges(spark, pairs), rounds=80, tolerance=1e-6).collect()}
    links = {}
    for s, d in set(pairs):
        links.setdefault(s, set()).add(d)
    new = {}
    for s, ds in links.items():
        for d in ds:
            if s in a:
                new[d] = new.get(d, 0.0) + a[s] / len(ds)
    new = {k: 0.15 + 0.85 * v for k, v in new.items()}
    assert new.keys() == a.keys() and all(abs(new[k] - a[k]) < 1e-4 for k in a)


def test_shortest_paths_in_bands(spark):
    """Equal to Dijkstra at several band widths, with zero weights, repeated edges, unreachable vertices and null ends."""
    import heapq

    draw = random.Random(6)
    edges = [(draw.randrange(30), draw.randrange(30), float(draw.choice([0, 1, 2, 5, 13]))) for _ in range(90)] + [(0, 1, 4.0), (0, 1, 9.0), (70, 71, 1.0), (None, 3, 1.0), (3, None, 1.0), (3, 4, None)]
    out = {}
    for a, b, w in edges:
        if None not in (a, b, w):
            out.setdefault(a, []).append((b, w))
    best, heap = {}, [(0.0, 0)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            for b, w in out.get(v, []):
                heapq.heappush(heap, (d + w, b))
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    for delta in (None, 1000.0):
        assert {r["id"]: r["dist"] for r in graphs.shortest_paths(df, 0, delta=delta).collect()} == best
    with pytest.raises(ValueError):
        graphs.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, w double"), 0)
    assert [tuple(r) for r in graphs.shortest_paths(df.limit(0), 5).collect()] == [(5, 0.0)]


def test_rounds_of_a_long_path_write_what_they_improve(spark, monkeypatch):
    plain = graphs.cut
    df = spark.range(9).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    rounds = []
    monkeypatch.setattr(graphs, "cut", lambda df, label="cut": rounds.append((label, x := plain(df, label), x.count())) or x)
    found = {r["id"]: r["dist"] for r in graphs.shortest_paths(df, 0, delta=4.0).collect()}
    assert found == {i: float(i) for i in range(10)}
    assert all(n <= 1 for label, _, n in rounds if label == "improved")


def test_ranks_satisfy_their_equation(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (5, 5), (6, 7)], "src long, dst long")
    got = {r["id"]: (r["rank"], r["residual"]) for r in graphs.pagerank_to_tolerance(edges, 1e-3).collect()}
    out = {1: [2, 3], 2: [3], 3: [1], 4: [3], 5: [5], 6: [7]}
    for v, (rank, residual) in got.items():
        sent = sum(got[s][0] / len(ds) for s, ds in out.items() if v in ds)
        assert 0 <= residual <= 1e-3 and abs(0.15 + 0.85 * sent - rank - residual) < 1e-12
    with pytest.raises(RuntimeError):
        graphs.pagerank_to_tolerance(edges, 1e-3, most=3)


def test_rounds_read_their_state_once(spark, monkeypatch):
    """What is written at once grows with its rounds, not with the power of two; a vertex may have more receivers than a row, and null is a vertex."""
    plain, joins = graphs.cut, {}

    def counted(df, label="cut"):
        joins.setdefault(label, []).append(sum("Join" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return plain(df, label)

    monkeypatch.setattr(graphs, "cut", counted)
    monkeypatch.setattr(graphs, "FAN", 4, raising=False)
    pairs = [(0, i) for i in range(1, 31)] * 2 + [(i, 0) for i in range(1, 31, 2)] + [(3, None), (None, 4), (2, 2)]
    got = {r["id"]: (r["rank"], r["residual"]) for r in graphs.pagerank_to_tolerance(spark.createDataFrame(pairs, "src long, dst long"), 1e-3).collect()}
    assert max(joins["ranks"]) == 5
    out = {}
    for s, d in set(pairs):
        if s is not None:
            out.setdefault(s, []).append(d)
    want = {v: (0.0, 0.15) for v in [*range(31), None]}
    while any(r > 1e-3 for _, r in want.values()):
        due = {v: r for v, (_, r) in want.items() if r > 1e-3}
        want = {v: (p + due.get(v, 0.0), 0.0 if v in due else r) for v, (p, r) in want.items()}
        for v, r in due.items():
            for d in out.get(v, []):
                if d is not None:
                    want[d] = want[d][0], want[d][1] + r * 0.85 / len(out[v])
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-12) for v in want)


def test_kmeans_bounds_and_limit(spark):
    import numpy as np

    from joulemill.plans.workloads import apart, kmeans, nearest

    draw = np.random.default_rng(8)
    places = draw.normal(size=(6, 5)) * 4
    x = places[draw.integers(0, 6, 600)] + draw.normal(size=(600, 5)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    centres = kmeans(df, 6, tolerance=0.0)
    near, best, measured = nearest(x, centres, apart(x, x[:6]), apart(centres, x[:6]))
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (near == every.argmin(1)).all() and np.allclose(best, every.min(1)) and measured < 0.6 * every.size
    for i in range(6):
        if (near == i).any():
            assert np.allclose(centres[i], x[near == i].mean(axis=0))
    with pytest.raises(RuntimeError):
        kmeans(df, 6, tolerance=0.0, most=1)
    assert len(kmeans(df.limit(0), 3)) == 0
