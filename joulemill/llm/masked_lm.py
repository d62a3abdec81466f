"""Language-model scoring by masked pseudo-likelihood.

A small network reads the words on both sides of a place and predicts the word there; the sum of the log-probabilities of all words of a document,
each given its neighbours, is the document's score. Words outside the most frequent share ids: the network predicts the shared id, and the
word's share in the counts of that id, taken over the whole corpus by Spark, gives its probability there. Every place of every document is
trained on, in one of the rounds. Training is data-parallel: in each round every partition takes its steps from the
common weights, and Spark averages the results block by block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from joulemill.llm.registry import query, table
from joulemill.storage import cut

CLASSES, MEMBERS = 32, 32  # the output is a class and a member of it; together the vocabulary
VOCABULARY = CLASSES * MEMBERS
RARE = 256  # ids that the words outside the most frequent share by hash
EDGE = VOCABULARY  # stands beyond either end of a document
SIDE = 2  # words read on each side
WIDTH = 24
ROUNDS = 4  # every place is trained on in one of them
GROUPS = 64  # the networks of a round are added up in so many groups, then the groups' sums
BATCH = 256
RATE = 0.1
PLACES = 1 << 15  # places scored at once
REMEMBERED = 300_000
PIECE = 1 << 16  # places that are stored and shuffled together in training
CHUNK = 16 * PIECE  # words and edges encoded together
LOOKED_UP = 1 << 17
PLACES_OF_SHARE = 12
SHARE = f"decimal(18,{PLACES_OF_SHARE})"
ROWS = 1 << 11  # of one product in scoring, so that they stay in the processor's cache
ADD = 0.5  # added to the count of a word that shares its id; words never seen have one such share together


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Numbers(dict):
    """Word -> its number, in the order in which words come."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_ids, sizes, codes, words): documents a chunk at a time. Their words, lower-cased and as ``split`` parts them, are numbers into ``words``, one
    document's after the other's; ``sizes`` says how many are whose. Texts are read and parted once, here."""
    out = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, words, size = [], [], Numbers(), 0

        def chunk() -> pa.RecordBatch:
            flat = np.concatenate(held).astype("<i4")  # byte by byte, as the high ones are mostly zero and compress well
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((ids, list(map(len, held)), flat.view(np.uint8).reshape(-1, 4).T.tobytes(), list(words)), out.types)], schema=out)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                parts = split(text.as_py())
                ids.append(key.as_py())
                held.append(np.fromiter(map(words.__getitem__, parts), dtype=np.int32, count=len(parts)))
                size += len(parts) + 2 * SIDE
                if size >= CHUNK:
                    yield chunk()
                    ids, held, words, size = [], [], Numbers(), 0
        if ids:
            yield chunk()

    key = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return docs.select(key.alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_ids array<long>, sizes array<long>, codes binary, words array<string>")


def decoded(codes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(codes, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


def chunk_counts(chunks: DataFrame) -> DataFrame:
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, words in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([words.values, pa.array(np.bincount(decoded(codes.as_py()), minlength=len(words.values)))], schema=out)

    return chunks.select("codes", "words").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))


def counted(docs: DataFrame) -> DataFrame:
    """(word, count) of the lower-cased words of the corpus, as ``split`` parts them."""
    return chunk_counts(encoded(docs))


def most_frequent(counts: DataFrame) -> list[str]:
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(VOCABULARY - RARE).collect()]


def frequent(docs: DataFrame) -> list[str]:
    """The most frequent words of the corpus, lower-cased; their number is fixed."""
    return most_frequent(counted(docs))


def shared(counts: DataFrame, top: list[str]) -> tuple[DataFrame, list[float]]:
    """Words that share ids with their counts, and of each shared id the logarithm of its total with what is added."""
    rare = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in top], "word string")), "word", "left_anti")
    totals = [ADD] * RARE
    for r in rare.groupBy((F.crc32(F.col("word").cast("binary")) % RARE).alias("id")).agg(F.sum("count").alias("n"), F.count("*").alias("words")).collect():
        totals[r["id"]] = r["n"] + ADD * (r["words"] + 1)
    return rare, np.log(totals).tolist()


def log_count(count) -> F.Column:
    """What a word that shares its id has of that id's counts, before the logarithm of the total: an exact decimal, so that the order of a sum doesn't show."""
    return F.ln(count + F.lit(ADD)).cast(SHARE)


def looked_up(rare: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """The commonest of the words that share ids, ``LOOKED_UP`` of them at most, with their ``log_count`` in units of its last place, for tasks to look up;
    and the others. The line is drawn by the logarithm of the count, so that no more words than these reach the driver."""
    level = F.floor(F.log2("count") * 8)
    line, n = 0, 0
    for r in sorted(rare.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        line, n = r["level"], n + r["n"]
        if n > LOOKED_UP:
            line += 1
            break
    found = rare.filter(level >= line).select("word", (log_count(F.col("count")) * F.lit(10**PLACES_OF_SHARE)).cast("long").alias("share"))
    return {r["word"]: r["share"] for r in found.collect()}, rare.filter(level < line)


class Ids(dict):
    """Word -> id; a word that isn't frequent gets one of the shared ids."""

    def __init__(self, top: list[str]) -> None:
        super().__init__((w, i) for i, w in enumerate(top))
        self.top = dict(self)

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self.update(self.top)
        found = self[word] = VOCABULARY - RARE + zlib.crc32(word.encode("utf-8", "replace")) % RARE
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Ids of a text with SIDE edges before and after."""
        return self.ids(split(text))

    def each(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int16, count=len(words))

    def ids(self, parts: list[str]) -> np.ndarray:
        return np.array([EDGE] * SIDE + list(map(self.__getitem__, parts)) + [EDGE] * SIDE, dtype=np.int16)


SHAPES = {"context": (2 * SIDE, VOCABULARY + 1, WIDTH), "bias": (WIDTH,), "classes": (WIDTH, CLASSES), "class_bias": (CLASSES,), "members": (CLASSES, WIDTH, MEMBERS), "member_bias": (CLASSES, MEMBERS)}


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    return {k: (draw.normal(0, 0.1, shape) if len(shape) > 1 and "bias" not in k else np.zeros(shape)).astype(np.float32) for k, shape in SHAPES.items()}


def windows(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Neighbour ids of each place (counted without the edges), left to right."""
    return np.stack([ids[places + SIDE + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    """Rows of probabilities, in place. Logits are held within +-60, so that nothing overflows."""
    np.exp(np.clip(x, -60, 60, out=x), out=x)
    x /= (x @ np.ones(x.shape[1], dtype=x.dtype))[:, None]
    return x


def log_chosen(x: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log-probability of one entry of each row."""
    np.clip(x, -60, 60, out=x)
    chosen = x[np.arange(len(x)), which]
    return chosen - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], dtype=x.dtype))


def hidden(net: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    total = net["context"][0].take(around[:, 0], axis=0)
    total += net["bias"]
    for p in range(1, 2 * SIDE):
        total += net["context"][p].take(around[:, p], axis=0)
    return np.tanh(total, out=total)


def log_likelihood(net: dict[str, np.ndarray], around: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """log P(centre | around) for each row: the class, then the member within it. Rows are sorted by class, one product for each."""
    out = np.empty(len(centre))
    order = np.argsort((centre // MEMBERS).astype(np.uint8), kind="stable")  # a radix sort
    for at in range(0, len(order), ROWS):
        rows = order[at : at + ROWS]
        group, member = np.divmod(centre[rows], MEMBERS)
        h = hidden(net, around[rows])
        both = np.empty((2, len(rows), MEMBERS), dtype=np.float32)
        np.dot(h, net["classes"], out=both[0])
        both[0] += net["class_bias"]
        bounds = np.searchsorted(group, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(bounds)):
            mine = slice(bounds[c], bounds[c + 1])
            np.dot(h[mine], net["members"][c], out=both[1, mine])
            both[1, mine] += net["member_bias"][c]
        chosen = log_chosen(both.reshape(-1, MEMBERS), np.concatenate([group, member])).astype(np.float64)
        out[rows] = chosen[: len(rows)] + chosen[len(rows) :]
    return out


def within(keys: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Order by batch and then by key, equal ones as they come. Both are short integers, which numpy sorts by their digits."""
    first = np.argsort(keys.astype(np.uint16), kind="stable")
    return first[np.argsort(batch[first].astype(np.min_scalar_type(int(batch[-1]))), kind="stable")]


class Repeats:
    """What the rows (keys ...) of a part's batches sum to, key by key: one entry for each different key of a batch. Only keys that come twice
    or more in their batch are added up."""

    def __init__(self, keys: np.ndarray, batch: np.ndarray) -> None:
        width, edges = keys.shape[1], np.arange(int(batch[-1]) + 2)
        flat, of = keys.ravel(), np.repeat(batch, width)
        order = within(flat, of)
        flat, of = flat[order], of[order]
        new = np.empty(len(flat), dtype=bool)
        new[0] = True
        np.not_equal(flat[1:], flat[:-1], out=new[1:])
        new[1:] |= of[1:] != of[:-1]
        starts = np.flatnonzero(new)
        n = np.diff(starts, append=len(flat))
        again, row = n > 1, order // width - of * BATCH
        self.keys, self.rows, self.bounds = flat[starts], row[starts], np.searchsorted(of[starts], edges)
        self.again, self.again_bounds = np.flatnonzero(again), np.searchsorted(of[starts[again]], edges)
        self.all_rows, self.ends = row[np.repeat(again, n)], np.concatenate([[0], np.cumsum(n[again])])

    def sums(self, i: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different keys of batch ``i``, and for each the sum of its rows."""
        lo, hi = self.bounds[i : i + 2]
        total = rows.take(self.rows[lo:hi], axis=0)
        a, z = self.again_bounds[i : i + 2]
        if a < z:
            at = self.ends[a : z + 1]
            total[self.again[a:z] - lo] = np.add.reduceat(rows.take(self.all_rows[at[0] : at[-1]], axis=0), at[:-1] - at[0], axis=0)
        return self.keys[lo:hi], total


def laid(net: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A network's weights as training multiplies them, with biases below their weights."""
    classes, members = np.concatenate([net["classes"], net["class_bias"][None]]), np.concatenate([net["members"], net["member_bias"][:, None]], axis=1)
    return {"context": net["context"].reshape(-1, WIDTH).copy(), "bias": net["bias"].copy(), "classes": classes, "members": members}


def unlaid(own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    classes, members = own["classes"], own["members"]
    parts = {"context": own["context"].reshape(SHAPES["context"]), "bias": own["bias"], "classes": classes[:-1], "class_bias": classes[-1], "members": members[:, :-1], "member_bias": members[:, -1]}
    return {k: np.ascontiguousarray(parts[k]) for k in SHAPES}


def train(net: dict[str, np.ndarray], parts: Iterable[np.ndarray], rate: float, seed: int) -> dict[str, np.ndarray]:
    """One pass of mini-batch gradient steps with per-weight rates over rows (neighbours ..., centre), which come in parts.

    What doesn't depend on the weights is laid out for all batches of a part at once: their rows by class, one product for each, and the contexts they share."""
    own = laid(net)
    speed = {k: np.full(v.shape, 1e-6, dtype=np.float32) for k, v in own.items()}
    draw = np.random.default_rng(seed)
    shift = np.arange(2 * SIDE, dtype=np.int32) * (VOCABULARY + 1)
    context, bias, classes, members = own.values()
    whole = [x.view(f"V{WIDTH * 4}").ravel() for x in (speed["context"], context)]  # a row as one item
    h, ones, back_m, grad_m = np.ones((BATCH, WIDTH + 1), dtype=np.float32), np.ones(BATCH, dtype=np.float32), np.empty((BATCH, WIDTH), dtype=np.float32), np.empty_like(members)
    of_class = [(members[c], members[c, :-1].T, grad_m[c]) for c in range(CLASSES)]

    def step(name: str, gradient: np.ndarray) -> None:
        speed[name] += gradient * gradient
        divisor = np.sqrt(speed[name])
        gradient *= rate
        gradient /= divisor
        own[name] -= gradient

    def step_context(index: np.ndarray, gradient: np.ndarray) -> None:
        divisor = speed["context"].take(index, axis=0)
        divisor += gradient * gradient
        whole[0][index] = divisor.view(whole[0].dtype).ravel()
        gradient *= rate
        gradient /= np.sqrt(divisor, out=divisor)
        moved = context.take(index, axis=0)
        moved -= gradient
        whole[1][index] = moved.view(whole[1].dtype).ravel()

    for data in parts:
        if not len(data):
            continue
        rows = data[draw.permutation(len(data))].astype(np.int32)
        batch = np.arange(len(rows), dtype=np.int32) // BATCH
        rows = rows[within(rows[:, -1], batch)]  # by class within each batch
        keys, centre = rows[:, :-1] + shift, rows[:, -1]
        contexts, around = Repeats(keys, batch), keys.T.astype(np.intp)
        group, member = np.divmod(centre.astype(np.intp), MEMBERS)
        bounds = np.searchsorted(batch * CLASSES + group, np.arange((int(batch[-1]) + 1) * CLASSES + 1))
        for i, lo in enumerate(range(0, len(rows), BATCH)):
            n = min(BATCH, len(rows) - lo)
            now, each, x = slice(lo, lo + n), np.arange(n), h[:n]
            at = (bounds[i * CLASSES : (i + 1) * CLASSES + 1] - lo).tolist()
            here = [(slice(a, z), *w) for w, a, z in zip(of_class, at, at[1:]) if a < z]
            near = context.take(around[:, now], axis=0)
            total = near[0] + bias
            for p in range(1, 2 * SIDE):
                total += near[p]
            x[:, :-1] = np.tanh(total, out=total)
            both = np.empty((2, n, MEMBERS), dtype=np.float32)
            up, up_m = both
            np.dot(x, classes, out=up)
            for mine, w, _, _ in here:
                np.dot(x[mine], w, out=up_m[mine])
            softmax(both.reshape(2 * n, MEMBERS))
            up[each, group[now]] -= 1
            up_m[each, member[now]] -= 1
            back = np.dot(up, classes[:-1].T)
            if len(here) < CLASSES:
                grad_m[:] = 0
            for mine, _, w, gradient in here:
                np.dot(up_m[mine], w, out=back_m[mine])
                np.dot(x[mine].T, up_m[mine], out=gradient)
            back += back_m[:n]
            step("members", np.divide(grad_m, n, out=grad_m))
            step("classes", np.dot(x.T, up) / n)
            back *= (1 - total * total) / n
            step("bias", np.dot(ones[:n], back))
            step_context(*contexts.sums(i, back))
    return unlaid(own)


def between_edges(sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Documents as ids one after the other, each between its edges."""
    flat, word = np.full(len(ids) + 2 * SIDE * len(sizes), EDGE, dtype=np.int16), np.ones(len(ids) + 2 * SIDE * len(sizes), dtype=bool)
    stops = np.cumsum(sizes + 2 * SIDE)
    for d in range(SIDE):
        word[stops - sizes - 2 * SIDE + d] = word[stops - 1 - d] = False
    flat[word] = ids
    return flat


def chunk_pieces(chunks: DataFrame, top: list[str], stride: int = 1) -> DataFrame:
    out = pa.schema([("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ids(top)
        for batch in batches:
            for sizes, codes, words in zip(*batch.columns):
                flat = between_edges(sizes.values.to_numpy(), known.each(words.values.to_pylist())[decoded(codes.as_py())])
                yield pa.RecordBatch.from_arrays([pa.array([flat[i : i + PIECE + 2 * SIDE].astype("<i2").tobytes() for i in range(0, len(flat) - 2 * SIDE, PIECE)], pa.binary())], schema=out)

    return chunks.select("sizes", "codes", "words").mapInArrow(run, "ids binary").withColumn("stride", F.lit(stride))


def gathered(docs: DataFrame, top: list[str], stride: int = 1) -> DataFrame:
    """(ids, stride): documents as ids one after the other, each between its edges, cut into pieces that overlap by SIDE ids at either end.
    Training takes every ``stride``-th place; 1, as the query has it, takes all."""
    return chunk_pieces(encoded(docs), top, stride)


def places_of(piece: np.ndarray, stride: int, turn: int, turns: int) -> np.ndarray:
    """Rows (neighbours ..., centre) of a piece's places whose turn it is."""
    places = np.flatnonzero(piece[SIDE:-SIDE] != EDGE)[::stride][turn::turns]
    return np.concatenate([windows(piece, places), piece[places + SIDE, None]], axis=1)


def fitted(data: DataFrame, rounds: int = ROUNDS, turns: int = 1) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` of local training and averaging. Each round takes the places of one of ``turns`` equal parts, in turn; with as many
    turns as rounds, every place comes once. Only averaged blocks, of the size of one network, reach the driver."""
    net = initial()
    for step in range(rounds):
        rate = RATE * (1 - step / rounds)

        def run(frames: Iterator[pd.DataFrame], net=net, rate=rate, step=step) -> Iterator[pd.DataFrame]:
            n, key = 0, 0

            def parts() -> Iterator[np.ndarray]:
                nonlocal n, key
                for f in frames:
                    for ids, stride in zip(f["ids"], f["stride"]):
                        rows = places_of(np.frombuffer(ids, dtype="<i2"), stride, step % turns, turns)
                        if len(rows):
                            n, key = n + len(rows), key or zlib.crc32(rows[:4096].tobytes())
                            yield rows

            mine = train(net, parts(), rate, step)
            if n:
                yield pd.DataFrame({"block": list(SHAPES), "key": key, "n": n, "weights": [(mine[k].astype(np.float64) * n).tobytes() for k in SHAPES]})

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total, n = 0.0, 0
            for r in frame.sort_values(["key", "n"]).itertuples():  # in a fixed order, so that reruns agree
                total, n = total + np.frombuffer(r.weights, dtype=np.float64), n + r.n
            return pd.DataFrame({"block": [frame["block"].iloc[0]], "key": [int(frame["key"].min())], "n": [n], "weights": [np.asarray(total).tobytes()]})

        row = "block string, key long, n long, weights binary"
        local = data.select("ids", "stride").mapInPandas(run, row)
        partial = local.groupBy("block", F.pmod("key", F.lit(GROUPS))).applyInPandas(add, row)
        for r in partial.groupBy("block").applyInPandas(add, row).collect():
            mean = np.frombuffer(r["weights"], dtype=np.float64) / r["n"]
            net[r["block"]] = mean.astype(np.float32).reshape(SHAPES[r["block"]])
    return net


def likelihood(ids: np.ndarray, net: dict[str, np.ndarray]) -> float:
    """Sum over all places of a document."""
    n, total = len(ids) - 2 * SIDE, 0.0
    for at in range(0, n, PLACES):
        places = np.arange(at, min(n, at + PLACES))
        total += float(log_likelihood(net, windows(ids, places), ids[places + SIDE].astype(np.int64)).sum())
    return total


def score(docs: DataFrame, top: list[str], net: dict[str, np.ndarray], counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) for every row; a document's places are scored together with others'.

    With ``counts``, a word that shares its id costs its share in that id's counts as well; without, the shared id alone is scored."""
    return chunk_scores(encoded(docs), top, net, counts)


def chunk_scores(chunks: DataFrame, top: list[str], net: dict[str, np.ndarray], counts: DataFrame | None = None) -> DataFrame:
    exact = pa.decimal128(38, PLACES_OF_SHARE)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_likelihood", pa.float64()), ("share", exact), ("rare", pa.list_(pa.string()))])
    rare, totals = shared(counts, top) if counts is not None else (None, [0.0] * RARE)
    total, listed = np.concatenate([np.zeros(VOCABULARY - RARE), totals]), rare is not None
    shares, rare = looked_up(rare) if listed else ({}, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ids(top)
        for batch in batches:
            for doc_ids, sizes, codes, words in zip(*batch.columns):
                names, n, codes = words.values.to_pylist(), sizes.values.to_numpy(), decoded(codes.as_py())
                each = known.each(names)
                share = np.fromiter((shares.get(w, 0) for w in names), dtype=np.int64, count=len(names))
                others = listed & (each >= VOCABULARY - RARE) & (share == 0)  # a share is the logarithm of 1.5 at least
                flat, ends, left = between_edges(n, each[codes]), np.concatenate([[0], np.cumsum(n)]), others[codes]
                sums, high, low, count = (np.zeros(len(n), dtype=t) for t in (float, np.int64, np.int64, np.int64))
                for at in range(0, len(codes), PLACES):
                    stop = min(at + PLACES, len(codes))
                    first, last = np.searchsorted(ends, [at, stop - 1], side="right") - 1
                    owner = np.repeat(np.arange(last + 1 - first), np.diff(np.clip(ends[first : last + 2], at, stop)))
                    some, mine = codes[at:stop], slice(first, last + 1)
                    ids = each[some]
                    sums[mine] += np.bincount(owner, weights=log_likelihood(net, windows(flat, np.arange(at, stop) + 2 * SIDE * (owner + first)), ids.astype(np.int64)) - total[ids])
                    high[mine] += np.bincount(owner, weights=share[some] >> 24).astype(np.int64)  # whole numbers far below 2^53
                    low[mine] += np.bincount(owner, weights=share[some] & 0xFFFFFF).astype(np.int64)
                    count[mine] += np.bincount(owner, weights=left[at:stop]).astype(np.int64)
                looked = [Decimal((a << 24) + b).scaleb(-PLACES_OF_SHARE) for a, b in zip(high.tolist(), low.tolist())]
                offsets = np.concatenate([[0], np.cumsum(count)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.values.take(pa.array(codes[left])))
                yield pa.RecordBatch.from_arrays([doc_ids.values, sizes.values, pa.array(sums), pa.array(looked, exact), lists], schema=out)

    row = f"doc_id long, n_words long, log_likelihood double, share decimal(38,{PLACES_OF_SHARE}), rare array<string>"
    scored = chunks.select("doc_ids", "sizes", "codes", "words").mapInArrow(run, row)
    if listed:
        scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        words = scored.select("row", F.explode("rare").alias("word"))
        found = words.join(rare, "word", "left").groupBy("row").agg(F.sum(log_count(F.coalesce("count", F.lit(0)))).alias("joined"))
        scored = scored.drop("rare").join(found, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + (F.col("share") + F.coalesce("joined", F.lit(0))).cast("double"))
    scored = scored.select("doc_id", "n_words", "log_likelihood")
    return scored.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.when(F.col("n_words") > 0, F.col("n_words")))


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains on ``docs`` and scores every row of it.

    Null and empty texts have no words, a sum of 0 and a null mean; repeated rows score alike; an empty table gives no rows; long texts are
    scored in parts that see across their borders; other columns are not read."""
    chunks = cut(encoded(docs), "chunks")
    counts = cut(chunk_counts(chunks), "counts")
    top = most_frequent(counts)
    return chunk_scores(chunks, top, fitted(cut(chunk_pieces(chunks, top), "ids"), turns=ROUNDS), counts)


@query("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))
