"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts get a model each, of letters given the three before them: words are inflected, so an expression is known by its letters. Both
discount their counts and back off to shorter contexts, by the number of different left neighbours; the shortest contexts are
counted over both classes, so what is rare in both gets nearly the same probability. The score is the difference of
the two log-likelihoods per letter, mapped to 0..1 by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from joulemill.llm.registry import query, table

ORDER, LETTER_BITS = 4, 8
DISCOUNT = 0.75
SHARED = 1  # orders that are counted over both classes
TRAIN_ROWS = 20_000  # bound on the labelled rows that are learnt from
CALIBRATE = 3  # the fold, doc_id's crc32 mod 4, that sets the curve; the counts come from folds 0 and 1
HELD_OUT = 2
THRESHOLD = 0.3
PIECE = 1 << 18  # letters scored at once


def alphabet() -> np.ndarray:
    """Code point -> 0 for what is no letter, else a letter number below 256; letters beyond Latin share numbers."""
    table = np.zeros(0x110000, dtype=np.uint8)
    letters = [c for c in range(0x250) if chr(c).isalpha()]
    folded = {c: ord(low) if len(low := chr(c).lower()) == 1 else c for c in letters}
    basic = {c: i + 1 for i, c in enumerate(sorted({c for c in folded.values() if c < 0x180}))}
    for c in letters:
        table[c] = basic.get(folded[c], 200 + folded[c] % 55)
    table[0x250:] = 200 + np.arange(0x250, 0x110000) % 55
    table[0x2000:0x2070] = table[0x3000:0x3021] = 0  # spaces and punctuation
    return table


def grams(text: str, letters: np.ndarray) -> np.ndarray:
    """The text's letter sequences of length ORDER, packed into integers. Whatever lies between words is one gap, and a text begins and ends with one."""
    numbers = letters[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), dtype="<u4")]
    gap = numbers == 0
    numbers = numbers[~(gap & np.concatenate([[False], gap[:-1]]))].astype(np.int64)
    padded = np.concatenate([np.zeros(ORDER - 2, dtype=np.int64), numbers])
    out = np.zeros(max(len(padded) - ORDER + 1, 0), dtype=np.int64)
    for j in range(ORDER):
        out = (out << LETTER_BITS) | padded[j : j + len(out)]
    return out if len(numbers) > 1 else out[:0]


def pieces(text: str) -> Iterator[str]:
    """A text in parts that overlap by no sequence: cut at blanks, so that memory is bounded for any length."""
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind(" ", at + 1, at + PIECE)
        end = end if end > at else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def folds(df: DataFrame) -> DataFrame:
    return df.withColumn("fold", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).cast("int"))


def sample(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic, fold) of at most ``rows`` labelled documents outside the held-out fold, chosen by hash."""
    known = folds(labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    return known.filter(f"fold <> {HELD_OUT}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def counts(docs: DataFrame) -> pd.DataFrame:
    """(gram, ordinary, toxic) of the sample's texts, also of what occurs once: bounded as the sample is."""
    out = pa.schema([("gram", pa.int64()), ("toxic", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = alphabet()
        for batch in batches:
            held: dict[int, list] = {0: [], 1: []}
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                held[int(toxic > 0)] += [grams(p, letters) for p in pieces(text.as_py() or "")]
            for toxic, found in held.items():
                if found:
                    key, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), toxic, dtype=np.int32)), pa.array(n)], schema=out)

    rows = docs.select(F.col("text").cast("string"), F.col("toxic").cast("int")).mapInArrow(run, "gram long, toxic int, n long")
    return rows.groupBy("gram").agg(*[F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(name) for t, name in ((0, "ordinary"), (1, "toxic"))]).toPandas()


def low(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` letters of each sequence."""
    return keys & ((1 << (LETTER_BITS * order)) - 1)


def model(sums: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    """Interpolated Kneser-Ney models of both classes, one table for each order: log-probabilities of the last letter (``p``, toxic and
    ordinary) for every known sequence and the log of the weight that a context leaves to the next lower order (``rest``).

    The highest order counts occurrences, the others different left neighbours. Orders up to SHARED count over both classes."""
    sums = sums.sort_values("gram")
    full, n = sums["gram"].to_numpy(dtype=np.int64), sums[["toxic", "ordinary"]].to_numpy(dtype=float).T
    tables: list[dict[str, np.ndarray]] = []
    for order in range(1, ORDER + 1):
        keys = np.unique(low(full, order))
        if order == ORDER:
            counts = n
        else:
            left = [np.unique(low(full[c > 0], order + 1)) for c in n]
            left = [np.union1d(*left)] * 2 if order <= SHARED else left
            counts = np.stack([np.bincount(np.searchsorted(keys, low(x, order)), minlength=len(keys)) for x in left]).astype(float)
        contexts, at = np.unique(keys >> LETTER_BITS, return_inverse=True)
        total = np.stack([np.bincount(at, weights=c, minlength=len(contexts)) for c in counts])
        kinds = np.stack([np.bincount(at, weights=c > 0, minlength=len(contexts)) for c in counts])
        rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        below = np.exp(tables[-1]["p"][:, np.searchsorted(tables[-1]["keys"], low(keys, order - 1))]) if tables else np.full((2, len(keys)), 1 / 256)
        p = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[:, at] + rest[:, at] * below
        tables.append({"keys": keys, "p": np.log(p), "contexts": contexts, "rest": np.log(rest)})
    tables[-1]["ratio"] = tables[-1]["p"][0] - tables[-1]["p"][1]
    return tables


def found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def log_p(tables: list[dict[str, np.ndarray]], x: np.ndarray, order: int) -> np.ndarray:
    """Log-probability of the last letter of each sequence of ``order`` letters, by class."""
    if not order:
        return np.full((2, len(x)), -np.log(256.0))
    table, out = tables[order - 1], np.empty((2, len(x)))
    at, hit = found(table["keys"], x)
    out[:, hit] = table["p"][:, at[hit]]
    miss = x[~hit]
    if len(miss):
        context, known = found(table["contexts"], miss >> LETTER_BITS)
        rest = np.where(known, table["rest"][:, context], 0.0) if len(table["contexts"]) else 0.0
        out[:, ~hit] = rest + log_p(tables, low(miss, order - 1), order - 1)
    return out


def ratios(tables: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Log ratio of the two models for each sequence."""
    at, hit = found(tables[-1]["keys"], x)
    out = tables[-1]["ratio"][at] if len(tables[-1]["keys"]) else np.zeros(len(x))
    if not hit.all():
        p = log_p(tables, x[~hit], ORDER)
        out[~hit] = p[0] - p[1]
    return out


def evidence(docs: DataFrame, fitted: list[dict[str, np.ndarray]]) -> DataFrame:
    """(doc_id, evidence): mean log ratio per letter of every row's whole text; 0 without letters."""
    out = pa.schema([("doc_id", pa.int64()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = alphabet()
        for batch in batches:
            means = []
            for text in batch.column(1):
                total, n = 0.0, 0
                for piece in pieces(text.as_py() or ""):
                    x = grams(piece, letters)
                    total += float(ratios(fitted, x).sum())
                    n += len(x)
                means.append(total / n if n else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.float64())], schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, evidence double")


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's steps on the slightly penalised likelihood; the slope is never negative."""
    if not len(x):
        return 10.0, -2.0
    scale = float(np.abs(x).max()) or 1.0
    z, w = np.stack([x / scale, np.ones(len(x))]), np.zeros(2)
    penalty = np.diag([1e-3, 1e-3]) * len(x) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)) @ z.T + penalty, z @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]) / scale, 1e-6), float(w[1])


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from at most ``rows`` labelled documents, none of them held out; labels are not read for anything else. Null and empty texts have
    evidence 0 and the score of the curve there; repeated rows score alike; a null id belongs to no fold and is not held out; without
    labels every text scores alike; other columns are not read."""
    known = F.broadcast(sample(labels, rows).withColumnRenamed("doc_id", "_id"))
    train = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id"))
    fitted = model(counts(train.filter(f"fold <> {CALIBRATE}")))
    marks = F.broadcast(sample(labels, rows).filter(f"fold = {CALIBRATE}").withColumnRenamed("doc_id", "_id"))
    held = evidence(docs.join(marks, F.col("doc_id") == F.col("_id"), "left_semi"), fitted).join(marks, F.col("doc_id") == F.col("_id")).select("evidence", "toxic").toPandas()
    slope, offset = curve(held["evidence"].to_numpy(dtype=float), (held["toxic"].to_numpy() > 0).astype(float))
    df = folds(evidence(docs, fitted))
    df = df.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") * slope + offset))))
    return df.select("doc_id", F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"), table(spark, folder, "labels"))
