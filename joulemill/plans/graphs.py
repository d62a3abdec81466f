"""Graph fixpoints as iterated joins. Every round writes its state to the shared folder, so lineage stays
short and a lost executor costs one round at most."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from joulemill.storage import cut

COMPACT = 10  # rounds kept as separate tables before they are written as one
FAN = 1024  # receivers in one row of a vertex's edges, about


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) pairs joined by a path. Only the pairs found in the last round are extended, and known
    pairs are removed by an anti join, so no pair is produced from the same prefix twice."""
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    known, fresh = edges, edges
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
    rounds = [edges]
    while True:
        grown = fresh.join(step, "dst").select("src", F.col("_next").alias("dst")).distinct()
        fresh = cut(grown.join(known, ["src", "dst"], "left_anti"), "closure")
        if fresh.isEmpty():
            return known
        rounds.append(fresh)
        known = reduce(DataFrame.union, rounds)
        if len(rounds) == COMPACT:
            known = cut(known, "closure")
            rounds = [known]


def pagerank(edges: DataFrame, rounds: int = 10, tolerance: float | None = None, every: int = 3) -> DataFrame:
    """Ranks start at 1.0 for every source; each round a page gets 0.15 + 0.85 * the shares sent to it.
    Pages without in-links drop out after the first round. With ``tolerance`` it stops once no rank moves more, and raises an error if one still
    does after the rounds."""
    links = edges.select("src", "dst").distinct()
    links = cut(links.join(links.groupBy("src").agg(F.count("*").alias("out")), "src"), "links")
    ranks = links.select(F.col("src").alias("id")).distinct().withColumn("rank", F.lit(1.0))
    for i in range(rounds):
        sent = links.join(ranks, links.src == ranks.id).select("dst", (F.col("rank") / F.col("out")).alias("share"))
        new = sent.groupBy(F.col("dst").alias("id")).agg((F.lit(0.15) + F.lit(0.85) * F.sum("share")).alias("rank"))
        if tolerance is not None or (i + 1) % every == 0:
            new = cut(new, "ranks")
        if tolerance is not None:
            old = ranks.select("id", F.col("rank").alias("_old"))
            moved = new.join(old, "id", "full").agg(F.max(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))))).first()[0]
            if moved is None or moved <= tolerance:
                return new
        ranks = new
    if tolerance is not None:
        raise RuntimeError(f"a rank still moves by more than {tolerance} after {rounds} rounds")
    return ranks


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest vertex id per undirected component, by alternating two steps until the edges are stars:
    hook every larger neighbour to the smallest one, then every smaller neighbour to the smallest one.
    Each step is one aggregate and one join; rounds grow with the logarithm of the size, not the diameter."""
    both = edges.filter("src <> dst").select("src", "dst")
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    pairs = cut(both.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "pairs")

    def large(p):
        two = p.union(p.select("b", "a")).toDF("v", "n")
        low = two.groupBy("v").agg(F.min("n").alias("m")).withColumn("m", F.least("m", "v"))
        return two.join(low, "v").filter("n > v").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()

    def small(p):
        low = p.groupBy("a").agg(F.min("b").alias("m"))
        moved = p.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(low.select("a", "m")).distinct()

    def mark(p):
        return tuple(p.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(pairs)
    while True:
        pairs = cut(small(large(pairs)), "pairs")
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return vertices.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles per vertex. Edges point from the vertex of lower degree to that of higher degree, which
    bounds the out-edges of any vertex (hubs included) by the square root of twice the edge count."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = cut(e, "undirected")
    degree = cut(e.select(F.col("a").alias("v")).union(e.select("b")).groupBy("v").agg(F.count("*").alias("d")), "degree")
    da = degree.select(F.col("v").alias("a"), F.col("d").alias("da"))
    db = degree.select(F.col("v").alias("b"), F.col("d").alias("db"))
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    directed = cut(e.join(da, "a").join(db, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi")), "directed")
    first, second = directed.toDF("x", "y"), directed.toDF("y", "z")
    paths = first.join(second, "y")
    closed = paths.join(directed.toDF("x", "z"), ["x", "z"])
    corners = closed.select(F.explode(F.array("x", "y", "z")).alias("id"))
    return corners.groupBy("id").agg(F.count("*").alias("triangles"))


def shortest_paths(edges: DataFrame, source: int, weight: str = "w", delta: float | None = None) -> DataFrame:
    """(id, dist): least total weight from ``source`` to every reachable vertex, by stepping through distance bands of width ``delta``.

    Known distances are a base table and the improvements of later rounds; a round writes only what it improved, and every COMPACT tables become one
    base. Vertices of the current band are relaxed until none of them improves, and only then the next band begins, so a far vertex waits until
    its distance has settled instead of being relaxed again and again. ``delta`` is four times the mean weight if not given; any positive width gives
    the same result. Edges with a null end or weight are left out; a negative weight raises an error, as no band would ever settle."""
    spark = edges.sparkSession
    e = cut(edges.select("src", "dst", F.col(weight).cast("double").alias("w")).dropna().groupBy("src", "dst").agg(F.min("w").alias("w")), "weighted")
    least, mean = e.agg(F.min("w"), F.avg("w")).first()
    if least is not None and least < 0:
        raise ValueError("shortest_paths needs weights of 0 and more")
    delta = delta or 4 * (mean or 0.0) or 1.0
    if not delta > 0:
        raise ValueError("delta must be positive")
    frontier = spark.createDataFrame([(source, 0.0)], "id long, dist double")
    tables, settled = [frontier], 0.0
    while True:
        end = settled + delta
        while True:
            offers = frontier.join(e, frontier.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
            known = reduce(DataFrame.union, tables).join(offers.select("id"), "id", "left_semi").groupBy("id").agg(F.min("dist").alias("dist"))
            better = offers.join(known, "id", "left").filter(F.col("dist").isNull() | (F.col("offer") < F.col("dist")))
            improved = cut(better.select("id", F.col("offer").alias("dist")), "improved")
            near, every = improved.agg(F.count_if(F.col("dist") < end), F.count("*")).first()
            if every:
                tables.append(improved)
            if len(tables) > COMPACT:
                tables = [cut(reduce(DataFrame.union, tables).groupBy("id").agg(F.min("dist").alias("dist")), "dist")]
            if not near:
                break
            frontier = improved.filter(F.col("dist") < end)
        best = reduce(DataFrame.union, tables).groupBy("id").agg(F.min("dist").alias("dist"))
        ahead = best.filter(F.col("dist") >= end)
        first = ahead.agg(F.min("dist")).first()[0]
        if first is None:
            return best
        if first + delta <= first:
            raise ValueError("delta is too small for distances of this size")
        settled = first  # the next band begins at the nearest vertex that waits
        frontier = ahead.filter(F.col("dist") < first + delta)


def pagerank_to_tolerance(edges: DataFrame, tolerance: float, damping: float = 0.85, most: int = 1000, every: int = 5) -> DataFrame:
    """(id, rank, residual) with rank = 1 - damping + damping * (the shares sent to it), up to ``tolerance``, by pushing residuals.

    A vertex holds a rank and a residual, what it has received and not passed on. Each round the vertices whose residual exceeds the tolerance add
    it to their rank and push ``damping`` of it along their edges; the others rest. A round is one join and one aggregate that read the state once, as every
    vertex also sends what it keeps to itself; ``every`` rounds are written together. At the end rank and residual satisfy the equation exactly
    (up to rounding) with every residual at or below the tolerance. The residuals shrink by ``damping`` a round in total, so ``most`` rounds are
    enough for any tolerance above 1e-60; should they not be, an error is raised rather than an unfinished result returned. Edges from null are left
    out; those to null count as edges, and null is a vertex that receives nothing."""
    links = edges.select("src", "dst").distinct()
    links = cut(links.join(links.groupBy("src").agg(F.count("*").alias("out")), "src"), "links")
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    # Rows of at most about FAN receivers, however many edges a vertex has. The one with out = 0 is the vertex's own.
    fan = F.pmod(F.xxhash64("dst"), F.ceil(F.col("out") / FAN)).alias("_fan")
    sends = links.filter("dst IS NOT NULL").groupBy(F.col("src").alias("id"), "out", fan).agg(F.collect_list("dst").alias("to")).drop("_fan")
    sends = cut(sends.unionByName(ids.dropna().select("id", F.lit(0).cast("long").alias("out"), F.array("id").alias("to"))), "sends")
    start = ids.select("id", F.lit(0.0).alias("rank"), F.lit(1 - damping).alias("residual"))
    own, pushes, residual = F.col("out") == 0, F.col("residual") > tolerance, F.col("residual")
    state = cut(start.dropna(), "ranks")
    for i in range(most):
        if i % every == 0 and state.filter(pushes).isEmpty():
            alone = start.filter("id IS NULL")
            return state.union(alone.select("id", F.when(pushes, residual).otherwise(F.col("rank")), F.when(pushes, 0.0).otherwise(residual)))
        sent = state.join(sends, "id").filter(own | pushes).select(
            F.explode("to").alias("id"),
            F.when(own, F.col("rank") + F.when(pushes, residual).otherwise(0.0)).otherwise(0.0).alias("rank"),
            F.when(own, F.when(pushes, 0.0).otherwise(residual)).otherwise(residual * damping / F.col("out")).alias("residual"))
        state = sent.groupBy("id").agg(F.sum("rank").alias("rank"), F.sum("residual").alias("residual"))
        if (i + 1) % every == 0:
            state = cut(state, "ranks")
    raise RuntimeError(f"residuals above {tolerance} are left after {most} rounds")
