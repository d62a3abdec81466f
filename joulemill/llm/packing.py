"""Packing tokenised documents into training sequences.

A document is cut only where it is longer than a sequence; full pieces are sequences of their own. The rest is dealt at random into
groups of bounded size, and each group is packed first-fit decreasing, with the free room of the bins in a tournament tree: the first bin with enough
room is found on one way down from the root.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from joulemill.llm.registry import query, table
from joulemill.storage import cut

LENGTH = 4096
END = 2  # the id that ends a document
GROUP = 16_384  # pieces in a group, about
CACHED = 400_000  # words whose ids a task remembers; it starts anew beyond
#: A run of Latin-1 letters and perhaps marks after it: the vocabulary's pre-tokenizer parts them there, and lower-cases letters one by one.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*|]*)")


def encoder(path: str):
    """Text -> ids as little-endian unsigned 32-bit bytes, the same as encoding the whole text at once.

    The pre-tokenizer drops white space and never joins across it, so the ids of a text are those of its blank-separated parts, and a
    part is encoded once for as long as it is remembered. Plain words go to the merge model directly, all others through the whole chain."""
    from tokenizers import Tokenizer

    whole, known = Tokenizer.from_file(path), {}
    latin = [chr(c) for c in range(ord("a"), 256) if PLAIN.fullmatch(chr(c))]
    as_bytes = str.maketrans({c: whole.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in latin})

    def part(text: str) -> bytes:
        if (ids := known.get(text)) is not None:
            return ids
        plain = PLAIN.fullmatch(text)
        if plain and plain[2]:
            ids = part(plain[1]) + part(plain[2])
        elif plain and (lower := text.lower()) != text:
            ids = part(lower)
        elif plain:
            ids = array("I", [t.id for t in whole.model.tokenize(text.translate(as_bytes))]).tobytes()
        else:
            ids = array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        known[text] = ids
        return ids

    def encode(text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            return b"".join(map(part, parts))

    return encode


def tokenise(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids binary, doc_tokens): the pieces of every row, at most ``length`` ids each, the end id included."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                rows += [(doc_id, at, min(length, total - at), ids[4 * at : 4 * (at + length)], total) for at in range(0, total, length)]
                held += len(ids)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def first_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, first-fit decreasing. The leaves of the tree are the bins, an inner node holds the most room below it."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    tree, bins, offsets = [room] * (2 * leaves), np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for k in order.tolist():
        size, node = int(sizes[k]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, room - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``length``; other columns pass through.

    Only the columns given are shuffled, so callers keep ids out of ``pieces``. Groups are dealt by a hash of the row's place in
    the written table: however many rows share an id, groups are even. Sequences of different groups never share an id."""
    rows = cut(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = rows.filter(F.col("length") == length).select(*pieces.columns, (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.filter(F.col("length") < length)
    groups, columns = max(1, -(-rest.count() // group)), [*pieces.columns, "sequence_id", "offset"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", ignore_index=True)
        bins, frame["offset"] = first_fit(frame["length"].to_numpy(), length)
        frame["sequence_id"] = (bins * groups + frame["_group"].to_numpy()) * 2
        return frame.drop(columns=["_row", "_group"])[columns]

    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInPandas(run, whole.schema)
    return packed.unionByName(whole)


def sequences(pieces: DataFrame, placed: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """(sequence_id, ids array<long>): what a trainer reads; padded to ``length`` unless its size is a power of two. Joins on (doc_id, start),
    which must be unique; a sequence holds at most ``length`` ids, so its group is bounded."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(frame.sort_values("offset")["ids"]), dtype="<u4").astype(np.int64)
        short = 0 if len(ids) & (len(ids) - 1) == 0 else length - len(ids)
        return pd.DataFrame({"sequence_id": [frame["sequence_id"].iloc[0]], "ids": [np.pad(ids, (0, short), constant_values=pad)]})

    both = pieces.select("doc_id", "start", "ids").join(placed.select("doc_id", "start", "sequence_id", "offset"), ["doc_id", "start"])
    return both.groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<long>")


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every row of ``docs``.

    A null or empty text is the end id alone; repeated rows are packed each on its own; an empty table gives no rows; other columns
    are not read."""
    pieces = tokenise(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(pieces)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_packing")
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), vocabulary())
