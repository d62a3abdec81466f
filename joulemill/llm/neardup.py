"""Near-duplicates: b-bit MinHash signatures and a multi-index Hamming join.

A signature has K values of b bits. It is split into M chunks; by the pigeonhole principle two signatures that differ in at most
R = M * (E + 1) - 1 values agree in some chunk up to E of its values, and all ways to leave out E values of a chunk are enumerated as keys: every pair
within R shares a key. Documents of one key are compared with pivots first, so that a large group of copies costs one comparison per member.
What still lies in different groups under one key is then met pair by pair. Edited copies of one text can all be within R of each other
without one link between them, so these pairs are met by their rarest shingles, which a linked pair must share, and not by the key itself;
they count only within R. Links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from joulemill.llm.collocations import bits_for, has, set_bits
from joulemill.llm.registry import query, table
from joulemill.llm.textbytes import Words, mixed, slices
from joulemill.plans.graphs import connected_components
from joulemill.storage import cut

SHINGLE = 5
SIMILARITY = 75  # hundredths
K, BITS, CHUNK, ERRORS = 64, 16, 4, 1
CHUNKS = K // CHUNK
R = CHUNKS * (ERRORS + 1) - 1  # 31 of 64 values: at similarity 0.75 sixteen differ on average, and 32 or more with probability below 1e-4
PIVOTS = 2  # members of a key that all others are compared with first
FOLD = np.random.default_rng(20240229).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLY = np.random.default_rng(20240301).integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = np.random.default_rng(20240302).integers(0, 2**63, K, dtype=np.uint64)


def shingle_sets(texts: pa.StringArray, words: Words) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: five words, or the whole sequence if it is shorter; empty without words."""
    for row, end, data, starts in slices(texts):
        hashes, counts = words.hashes(data, starts)
        folded = np.zeros(max(len(hashes) - SHINGLE + 1, 0), dtype=np.uint64)
        for j in range(SHINGLE):
            folded += hashes[j : j + len(folded)] * FOLD[j]
        folded = mixed(folded, SHINGLE)
        at = 0
        for n in counts.tolist():
            if n >= SHINGLE:
                yield np.unique(folded[at : at + n - SHINGLE + 1])
            else:
                yield mixed(np.sum(hashes[at : at + n] * FOLD[:n], keepdims=True, dtype=np.uint64), n) if n else hashes[:0]
            at += n


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bits of the smallest value under each of K hash functions."""
    low = np.full(K, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * MULTIPLY + ADD).min(axis=0), out=low)
    return (mixed(low) & np.uint64((1 << BITS) - 1)).astype("<u2")


def set_hash(shingles: np.ndarray) -> tuple[int, int, int]:
    """Size and two independent 64-bit hashes of a set."""
    return (len(shingles), *(int(mixed(shingles, seed).sum(dtype=np.uint64).astype(np.int64)) for seed in (101, 102)))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature): size, two independent hashes and the signature of each row's shingle set."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            if not len(batch):
                continue
            found = [(*set_hash(s), signature(s).tobytes() if len(s) else None) for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t.type) for c, t in zip(zip(*found), list(out)[1:]))], schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def class_id() -> Column:
    return F.xxhash64("n_shingles", "set_a", "set_b")


def keys(classes: DataFrame) -> DataFrame:
    """(key, cls, n): for every chunk and every choice of values left out of it, one key from those that remain."""
    out = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
                rows = len(part)
                values = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype="<u2").reshape(rows, CHUNKS, CHUNK).astype(np.uint64)
                found = []
                for left_out in range(CHUNK):
                    rest = [values[:, :, j] << np.uint64(BITS * i) for i, j in enumerate(x for x in range(CHUNK) if x != left_out)]
                    found.append(mixed((rest[0] | rest[1] | rest[2]) + (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(left_out) << np.uint64(48)), 7))
                key = np.stack(found, axis=2).reshape(rows, -1)
                wide = [np.repeat(part.column(i).to_numpy(), key.shape[1]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(wide[0]), pa.array(wide[1])], schema=out)

    return classes.select("cls", F.col("n_shingles").alias("n"), "signature").mapInArrow(run, "key long, cls long, n long")


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("signature").alias("s" + x), F.col("n_shingles").alias("n" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits(F.col("na"), F.col("nb")))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, K) for i in (2, 3))
            close = pa.array((x != y).sum(axis=1) <= R)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(close), batch.column(1).filter(close)], schema=out)

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def id_hashes(ids: pa.Int64Array) -> np.ndarray:
    return mixed(ids.to_numpy().astype(np.uint64), 11)


def among(wanted: DataFrame) -> np.ndarray:
    """A bit for the hash of every ``doc_id`` in ``wanted``. Its size is bounded, so that other ids may have theirs."""
    size = bits_for(wanted.count())
    shift = np.uint64(64 - (size.bit_length() - 1))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((id_hashes(batch.column(0)) >> shift).astype(np.int64) + 1)], names=["place"])

    return set_bits(wanted.select("doc_id").mapInArrow(places, "place long"), size)


def full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, shingles) for the classes ``cls`` in ``wanted``, whose sets are built again from their texts.

    The ids reach the tasks as a bit array, so that no text is shuffled to meet them."""
    wanted = cut(wanted.select("cls").distinct().join(classes.select("cls", "doc_id"), "cls"), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(among(wanted))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).filter("doc_id is not null")
    out = pa.schema([("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            mine = batch.column(1).filter(pa.array(has(bits.value, id_hashes(batch.column(0)))))
            for part in (mine.slice(i, 256) for i in range(0, len(mine), 256)):
                sets = list(shingle_sets(part, words))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*map(set_hash, sets))), lists], schema=out)

    # An error of a bit or a repeated id may bring texts of other sets along: the class, made anew, tells.
    sets = texts.mapInArrow(run, "n_shingles long, set_a long, set_b long, shingles array<long>").select(class_id().alias("cls"), "shingles")
    return cut(sets.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) with the similarity of the full sets."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (shared * 100 >= (F.size("x") + F.size("y") - shared) * SIMILARITY).alias("linked"))


def rarest(sets: DataFrame) -> DataFrame:
    """(cls, n, token, place): the shingles of a set at the places, counted from 1 and from the rarest on, where a linked pair of sets must have its first
    one in common. Those that no other set holds come first, and only their number is needed."""
    tokens = sets.select("cls", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    lists = tokens.join(held, "token").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("list"))
    most = F.floor(F.col("n") * (100 - SIMILARITY) / 100) + 1  # against the shortest set that can be linked
    alone = F.col("n") - F.size("list")
    first = F.slice("list", F.lit(1), F.greatest(most - alone, F.lit(0)).cast("int"))
    return lists.select("cls", "n", alone.alias("alone"), F.posexplode(first).alias("at", "_t")).select("cls", "n", F.col("_t.token").alias("token"), (F.col("alone") + F.col("at") + 1).alias("place"))


def fits(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * SIMILARITY


def link(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, component) for the classes that share a key with another. Exact copies are one class already."""
    every = keys(classes)
    shared = every.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("key")
    members = cut(every.join(shared, "key"), "members")
    ordered = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    # Every member against the pivots of its keys: one comparison for each member and pivot, however many members there are. The first
    # pivot is the most central member, whose keys are shared most often: the origin of a family of edited copies, which may be
    # near all of them while they are not near each other. The others are drawn by hash.
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    central = members.join(sizes, "key").groupBy("cls").agg(F.sum("size").alias("central"))
    ranked = cut(members.join(central, "cls"), "ranked")
    drawn = [F.min(F.struct((-F.col("central")).alias("h"), "cls", "n")), *[F.min(F.struct(F.xxhash64(F.lit(i), "cls").alias("h"), "cls", "n")) for i in range(1, PIVOTS)]]
    pivots = ranked.groupBy("key").agg(*[p.alias(f"p{i}") for i, p in enumerate(drawn)])
    met = ranked.join(pivots, "key").select("cls", "n", F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("p"))
    tested = cut(ordered(met.filter((F.col("cls") != F.col("p.cls")) & fits(F.col("n"), F.col("p.n"))).select(F.col("cls").alias("x"), F.col("p.cls").alias("y"))), "pairs")
    close = cut(near(tested, classes), "close")
    links = cut(confirmed(close, full_sets(close.select(F.explode(F.array("a", "b")).alias("cls")), classes, docs)).filter("linked"), "links")
    groups = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).toDF("cls", "_c")
    component = cut(members.select("cls").distinct().join(groups, "cls", "left").select("cls", F.coalesce("_c", "cls").alias("component")), "components")

    # What still lies in different components under one key, pair by pair. A linked pair has at least ``shared`` shingles in common, so the first
    # common one has at least shared - 1 others behind it in both sets.
    left = members.join(component, "cls")
    mixed_keys = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    left = cut(left.join(mixed_keys, "key", "left_semi").select("cls", "component").distinct(), "open")
    sets = full_sets(left, classes, docs)
    rare = rarest(sets).join(left, "cls")
    # Members of one component need not meet: those of a shingle's largest component meet only the others, so a large family with a few strangers
    # costs members times strangers.
    main = rare.groupBy("token", "component").agg(F.count("*").alias("_n")).groupBy("token").agg(F.max_by("component", F.struct("_n", "component")).alias("main"), F.count("*").alias("_k"))
    rare = cut(rare.join(main.filter("_k > 1").drop("_k"), "token").withColumn("main", F.col("component") == F.col("main")), "rarest")
    n, n2 = F.col("n"), F.col("n2")
    shared = F.ceil((n + n2) * SIMILARITY / (100 + SIMILARITY))
    order = (n < n2) | ((n == n2) & (F.col("cls") < F.col("cls2")))  # the shorter set on the left, where fewer places are enough
    meets = order & (F.col("component") != F.col("component2")) & fits(n, n2) & (F.col("place") <= n - shared + 1) & (F.col("place2") <= n2 - shared + 1)
    short = rare.filter(F.col("place") <= n - F.ceil(2 * n * SIMILARITY / (100 + SIMILARITY)) + 1)
    other = rare.select("token", *[F.col(c).alias(c + "2") for c in ("cls", "n", "component", "place", "main")])
    sides = [(short.filter("not main"), other), (short.filter("main"), other.filter("not main2"))]
    met = reduce(DataFrame.union, [x.join(y, "token").filter(meets).select("cls", "cls2") for x, y in sides])
    rest = cut(ordered(met.toDF("x", "y")).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = confirmed(near(rest, classes), sets).filter("linked")
    name = lambda x: component.select(F.col("cls").alias(x), F.col("component").alias("_" + x))
    bridges = cut(more.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct(), "bridges")
    if bridges.isEmpty():
        return component
    joined = connected_components(bridges).toDF("component", "_c")
    return component.join(joined, "component", "left").select("cls", F.coalesce("_c", "component").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked where 100 * |intersection| >= 75 * |union| of their shingle sets, and a component is what links reach; its smallest id
    is kept. Empty and null texts have no shingles and are alone. Rows without an id are kept, linked with nothing, and their
    component is null. Repeated rows are copies of each other; an id given to several texts joins none of them. An empty table gives no rows;
    other columns are not read."""
    sets = cut(signed(docs), "sets")
    classes = cut(sets.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")).withColumn("cls", class_id()), "classes")
    component = link(docs, classes)
    named = classes.select("cls", "doc_id").join(component, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(lowest, "component").select("cls", "component_id")
    rows = sets.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), class_id()).alias("cls"))
    df = rows.join(ids, "cls", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return df.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


@query("op2_near_dedup")
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
