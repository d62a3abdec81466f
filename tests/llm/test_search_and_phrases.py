"""Top-k by product, centroids and collocations against brute force, with odd rows and hot keys."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from joulemill.llm import centroids, collocations, registry, topk
from tests.harness import difference, duck, duck_table, spark_table

VECTORS = "vec_id long, embedding array<double>"
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", ["op11_topk", "op12_centroids", "op13_collocations"])
def test_equal_to_sql(name, spark, folder):
    assert difference(spark_table(registry.load()[name](spark, folder)), duck_table(duck(folder), registry.SQL[name])) is None


def floored(vector, scale):
    return [int(np.floor(scale * float(x))) for x in vector]


def brute_top(rows, k=topk.NEIGHBOURS, scale=topk.SCALE):
    good = [(i, floored(v, scale)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, z in good:
        if i % 20 == 0:
            asked[i] = min(z, asked.get(i, z))
    out = []
    for q, zq in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(zq, z)), i) for i, z in good if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def spark_top(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).withColumns({"score": F.lit("x"), "norm": F.lit(1), "bucket": F.lit(2), "slot": F.lit(3)})
    return sorted(tuple(r) for r in topk.largest_products(df, df.filter("vec_id % 20 = 0")).collect())


def grouped_vectors(draw, n, lengths):
    centres = draw.normal(size=(15, 12))
    v = centres[draw.integers(0, 15, n)] + draw.normal(size=(n, 12)) * 0.05
    return v / np.linalg.norm(v, axis=1, keepdims=True) * lengths[:, None]


def test_top_over_many_buckets(spark, monkeypatch):
    """Close groups make coordinates prune, spread lengths make lengths prune; a third of the rows are one vector."""
    monkeypatch.setattr(topk, "BUCKET", 128)
    monkeypatch.setattr(topk, "QUERIES", 32)
    monkeypatch.setattr(topk, "MOST_BUCKETS", 7)
    draw = np.random.default_rng(11)
    v = grouped_vectors(draw, 1800, np.exp(draw.normal(size=1800) * 0.3))
    v[:600] = v[0]
    rows = [(int(i), x.tolist()) for i, x in zip(draw.permutation(1800), v)]
    assert spark_top(spark, rows) == brute_top(rows)


def test_top_with_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    draw = np.random.default_rng(5)
    rows = [(40 if i % 3 else i, x.tolist()) for i, x in enumerate(draw.integers(-2, 3, (400, 3)) / 64)]
    rows += [(41, [0.0, 0.0, 0.0])] * 30
    assert spark_top(spark, rows) == brute_top(rows)


def test_each_pruning_keeps_what_counts():
    draw = np.random.default_rng(2)
    z = np.floor(64 * grouped_vectors(draw, 500, np.ones(500))).astype(np.int64)
    bucket = topk.Bucket(np.arange(500), z)
    scores = z @ z.T
    for i in range(0, 500, 25):
        floor = np.sort(scores[i])[-15]
        cosine = floor / (np.linalg.norm(z[i]) * bucket.norms[0])
        near = bucket.near(z[i].astype(float), cosine)
        assert cosine > topk.STEEP and len(near) < 250
        assert set(np.flatnonzero(bucket.z @ z[i] >= floor)) <= set(near)
    floors = np.sort(scores, axis=1)[:, -15].astype(float)
    by_floor = bucket.search(np.arange(500), z, floors, 5)
    plain = bucket.search(np.arange(500), z, np.full(500, np.nan), 5)
    assert sorted(by_floor) == sorted(plain)


def test_top_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [NAN, 1.0]), (4, [INF, 1.0]), (5, [None, 1.0]), (6, [2.0, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0]), (9, [1.0, 1.0, 9.0])]
    rows += [(20, [0.0, -3.0]), (20, [0.0, -3.0]), (20, [0.0, 3.0]), (-40, [1e7, -1e7]), (11, [1e7, 1e6]), (13, [1e7, 1e6 + 0.02]), (12, [1e7, 1e6])]
    assert spark_top(spark, rows) == brute_top(rows)
    huge = spark_top(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])])
    assert huge == [(0, 1, 1, topk.LONG), (0, 2, 2, -topk.LONG)]
    assert spark_top(spark, []) == [] and spark_top(spark, [(0, None), (20, None)]) == [] and spark_top(spark, [(1, [1.0])]) == []


def brute_centroids(rows, width, clusters=8, rounds=10, scale=1024):
    good = [(i, floored(v, scale)) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [z for _, z in starts[:clusters]]
    near = lambda z: min((sum((a - b) ** 2 for a, b in zip(z, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(z)[1] for _, z in good]
        for k in range(len(centres)):
            mine = [z for (_, z), o in zip(good, own) if o == k]
            if mine:
                centres[k] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, *near(z)[::-1]) for i, z in good]
    of = Counter()
    for _, k, d in found:
        of[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    top = centroids.LONG
    return sorted(((i is None, i or 0), k, min(top, d), min(top, of[k]), min(top, sum(of.values())), digest[k]) for i, k, d in found)


def spark_centroids(spark, rows, width):
    df = spark.createDataFrame(rows, VECTORS).withColumns({"cluster": F.lit("x"), "z": F.lit(1), "pivots": F.lit(2)})
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in centroids.centroids(df, components=width).collect())


def test_centroids(spark):
    draw = np.random.default_rng(7)
    v = grouped_vectors(draw, 700, np.ones(700))
    v[:250] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    assert spark_centroids(spark, rows, 12) == brute_centroids(rows, 12)


def test_centroids_with_ties_and_odd_rows(spark):
    rows = [(i, [float(i % 4), float(i % 3)]) for i in range(60)] + [(7, [1.0, 1.0])] * 5
    rows += [(None, [0.5, 0.25]), (100, None), (101, [1.0]), (102, [NAN, 1.0]), (103, [1.0, None]), (104, [INF, 0.0]), (105, [])]
    assert spark_centroids(spark, rows, 2) == brute_centroids(rows, 2)
    few = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [5.0, 5.0])]  # two equal starts: the second stays empty
    assert spark_centroids(spark, few, 2) == brute_centroids(few, 2)
    assert spark_centroids(spark, [], 2) == [] and spark_centroids(spark, [(1, None)], 2) == []
    far = [(i, [(-1.0) ** i * 1e7 * i, 3.0 * i]) for i in range(30)]
    assert spark_centroids(spark, far, 2) == brute_centroids(far, 2)


def test_pivots_pass_over_centroids():
    draw = np.random.default_rng(3)
    z = np.floor(1024 * grouped_vectors(draw, 2000, np.ones(2000))).astype(np.int64)
    centres = z[:8]
    apart = lambda p: np.sqrt(((z - p) ** 2).sum(axis=1).astype(float))
    to = np.stack([apart(p) for p in z[:16]], axis=1)
    cluster, best, measured = centroids.assign(z, to, centres, to[:8])
    every = np.stack([((z - c) ** 2).sum(axis=1) for c in centres], axis=1)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert measured < 0.5 * every.size


def brute_phrases(rows, least, first):
    lower = str.maketrans(collocations.LETTERS, collocations.LETTERS.lower())
    marks = str.maketrans({c: "\n" for c in ".,;:!?\x0b\x0c\r"})
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in (text or "").translate(lower).translate(marks).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {}
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(a, inside.get((lang, p[i : i + m]), 0))
    out = {}
    for (lang, p), a in candidates.items():
        if 100 * inside.get((lang, p), 0) < 80 * a:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1))


def spark_phrases(spark, rows, least, first=50):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"prefix": F.lit(1), "next": F.lit("y"), "f": F.lit(2), "phrase": F.lit("z")})
    return sorted(tuple(r) for r in collocations.collocations(df, least, first).collect())


@pytest.mark.parametrize("tokens, slab, words", [(1 << 21, 1 << 20, 1 << 20), (50, 40, 20)])
def test_phrases(spark, monkeypatch, tokens, slab, words):
    """Whole and cut into small slabs and runs, with a hot word, ties and repeated rows."""
    monkeypatch.setattr(collocations, "TOKENS", tokens)
    monkeypatch.setattr(collocations, "SLAB", slab)
    monkeypatch.setattr(collocations, "WORDS", words)
    monkeypatch.setattr(collocations, "SEGMENTS", 8)
    draw = random.Random(4)
    vocabulary = ["the", "the", "the", "A", "b", "Éa", "éa", "new", "york", "ı", "x-y", "'"]
    text = lambda n: "".join(draw.choice(["the old man ", "New York City ", draw.choice(vocabulary) + " ", draw.choice(vocabulary) + draw.choice([". ", "\n", ",", "\t", " ", "\x0b"])]) for _ in range(n))
    rows = [(draw.choice(["en", "en", "de", None, "und", ""]), text(draw.randint(0, 40))) for _ in range(120)] + [("en", text(1500)), ("en", "the the the the " * 300)] + [("de", "b b c")] * 40
    assert spark_phrases(spark, rows, 6) == brute_phrases(rows, 6, 50)


def test_phrases_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", " .,\t\n"), ("en", "a" * 5000), ("de", "x\x00y \x1c z " * 4)] * 2
    assert spark_phrases(spark, rows, 3) == brute_phrases(rows, 3, 50) != []
    assert spark_phrases(spark, rows, 100) == [] and spark_phrases(spark, [], 1) == [] and spark_phrases(spark, [(None, None), ("en", "")], 1) == []


def test_bits_hold_every_phrase(spark):
    df = spark.range(5000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), F.col("id"), F.lit(" v"), F.col("id") % 7).alias("phrase"))
    bits = collocations.bit_array(df, 5000)
    hashes = np.array([collocations.phrase_hash("en", f"w{i} v{i % 7}") for i in range(5000)], dtype=np.uint64)
    assert collocations.has(bits, hashes).all()
    other = np.array([collocations.phrase_hash("de", f"w{i} v{i % 7}") for i in range(5000)], dtype=np.uint64)
    assert collocations.has(bits, other).mean() < 0.15
