"""Phrase collocations by stripes: a prefix keys a counter of its next words.

Level k reads the texts and, for every prefix of k - 1 words, counts the word that follows. A partition merges its own stripes; Spark brings those
of a prefix together and adds them element by element. The merged stripes give all that a phrase needs: the elements are the extensions of a
prefix with their counts, the largest of them subsumes it, and its own total is its element in the stripe one level up. The empty prefix's
stripe holds the words of a language, and its sum is their number.

A phrase that occurs often enough consists of parts that do, so level k counts only extensions of frequent prefixes by which the last k - 1 words
are frequent too. The frequent phrases of a level reach the tasks as a bit array over hashes, of bounded size; an error of it costs a count too
many, never one too few. Stripes of the few prefixes that hold a large share of all words are cut into segments by the next word.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from joulemill.llm.registry import query, table
from joulemill.storage import cut

LEAST = 30
LONGEST = 4
COVER = 80  # per cent of a phrase's count from which a longer one covers it
FIRST = 2_000
FACTOR = 2_000_000
TOKENS = 1 << 21  # that a task counts before it hands out its stripes
SLAB = 1 << 20  # bytes of a text that are split at once
WORDS = 1 << 20  # different words after which a task forgets its numbers
MOST_BITS = 1 << 26  # of a bit array
SEGMENTS = 1_024  # of a language's words, and least shares of all words that a prefix's segments hold

#: ASCII capitals to small letters, the marks that end a piece to ".", tabulators to blanks.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz.......... ")
EDGE = re.compile(rb"[ .]")

STRIPE = "lang string, prefix string, segment int, next array<string>, counts array<long>"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its first words and its last."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """Numbers of the words of each language from 1 on; 0 ends a piece."""

    def __init__(self):
        self.names: list[bytes] = [b""]
        self.hashes = array("Q", [0])
        self.langs = array("i", [0])  # of each word, its place in the next
        self.lang_names: list[str] = []
        self.by_lang: dict[str, dict[bytes, int]] = {}

    def of(self, lang: str) -> dict[bytes, int]:
        if lang not in self.by_lang:
            seed = xxhash.xxh64_intdigest(lang.encode())
            words, place = self, len(self.lang_names)
            self.lang_names.append(lang)

            class Numbers(dict):
                def __missing__(self, word: bytes) -> int:
                    self[word] = number = len(words.names)
                    words.names.append(word)
                    words.langs.append(place)
                    words.hashes.append(xxhash.xxh64_intdigest(word, seed))
                    return number

            self.by_lang[lang] = Numbers({b".": 0})
        return self.by_lang[lang]


def phrase_hash(lang: str, phrase: str) -> int:
    seed = xxhash.xxh64_intdigest(lang.encode())
    first, *rest = (np.array([xxhash.xxh64_intdigest(w, seed)], dtype=np.uint64) for w in phrase.encode().split(b" "))
    for word in rest:
        first = mixed(first, word)
    return int(first[0])


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of these hashes are set, in an array whose number of bits is a power of two."""
    at = hashes >> np.uint64(64 - int(math.log2(len(bits) * 8)))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def slabs(text: bytes) -> Iterator[list[bytes]]:
    """Words and ends of pieces ("."), from about SLAB bytes at once, never cut inside a word."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        edge = EDGE.search(text, at + SLAB)
        end = edge.start() if edge else len(text)
        yield text[at:end].replace(b".", b" . ").split()
        at = end


def stripes(words: Words, tokens: np.ndarray, own: np.ndarray, level: int, bits: list[np.ndarray], hot: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    """The merged stripes of one run of tokens. ``own`` is false for those that only stand before others here and are counted elsewhere."""
    hashes, lang_of = np.array(words.hashes, dtype=np.uint64), np.array(words.langs, dtype=np.int64)
    phrase = np.where(tokens > 0, tokens, -1)  # number of the phrase of level - 1 words that ends here, -1: none
    seen = np.arange(len(hashes))  # a place where it ends; for single words their numbers
    if level > 1:
        phrase[(phrase >= 0) & ~has(bits[0], hashes)[tokens]] = -1
    own_hashes = hashes
    for j in range(2, level):
        at = np.flatnonzero((phrase[1:] >= 0) & (phrase[:-1] >= 0)) + 1
        keys, first, back = np.unique(phrase[at - 1] << 32 | tokens[at], return_index=True, return_inverse=True)
        own_hashes = mixed(own_hashes[keys >> 32], hashes[keys & 0xFFFFFFFF])
        phrase = np.full(len(tokens), -1)
        phrase[at] = np.where(has(bits[j - 1], own_hashes), np.arange(len(keys)), -1)[back]
        seen = at[first]
    if level == 1:
        at = np.flatnonzero(own & (tokens > 0))
        nexts, counts = np.unique(tokens[at], return_counts=True)
        keys, prefixes = nexts, lang_of[nexts]
    else:
        at = np.flatnonzero(own[1:] & (phrase[:-1] >= 0) & (phrase[1:] >= 0)) + 1
        keys, counts = np.unique(phrase[at - 1] << 32 | tokens[at], return_counts=True)
        prefixes, nexts = keys >> 32, keys & 0xFFFFFFFF
    if not len(keys):
        return
    names = pa.array(words.names, pa.binary())
    groups, which = np.unique(prefixes, return_inverse=True)
    if level == 1:
        first, texts = None, pa.array([b""] * len(groups), pa.binary())
    elif level == 2:
        first, texts = groups, names.take(pa.array(groups))
    else:
        places = [tokens[seen[groups] - back] for back in range(level - 2, -1, -1)]
        first, texts = places[0], pc.binary_join_element_wise(*[names.take(pa.array(p)) for p in places], b" ")
    langs = pa.array(words.lang_names, pa.string()).take(pa.array(groups if first is None else lang_of[first]))
    parts = np.full(len(groups), SEGMENTS if level == 1 else 1, dtype=np.uint64)
    if hot:
        for i in np.flatnonzero(pc.is_in(texts, pa.array([phrase.encode("utf-8", "surrogatepass") for _, phrase in hot], pa.binary())).to_numpy(zero_copy_only=False)):
            parts[i] = hot.get((langs[i].as_py(), texts[i].as_py().decode("utf-8", "replace")), 1)
    segment = (hashes[nexts] % parts[which]).astype(np.int64)
    order = np.lexsort((nexts, segment, which))
    which, segment, nexts, counts = which[order], segment[order], nexts[order], counts[order]
    starts = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (segment[1:] != segment[:-1])))
    offsets, owner = pa.array(np.append(starts, len(which)), pa.int32()), pa.array(which[starts])
    string = lambda values: values.view(pa.string())
    batch = pa.RecordBatch.from_arrays(
        [
            langs.take(owner),
            string(texts.take(owner)),
            pa.array(segment[starts], pa.int32()),
            pa.ListArray.from_arrays(offsets, string(names.take(pa.array(nexts)))),
            pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
        ],
        names=["lang", "prefix", "segment", "next", "counts"],
    )
    for at in range(0, batch.num_rows, 1 << 16):
        yield batch.slice(at, 1 << 16)


def counted(batches: Iterator[pa.RecordBatch], level: int, bits: list[np.ndarray], hot: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    """Stripes of a partition of (lang, text). A run ends after TOKENS; a text that goes on is led by its last words."""
    words, run, own, size = Words(), [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            numbers, before = words.of(lang), np.zeros(1, dtype=np.int64)
            for slab in slabs(text.as_py()):
                if size >= TOKENS:
                    yield from stripes(words, np.concatenate(run), np.concatenate(own), level, bits, hot)
                    run, own, size = [], [], 0
                    if len(words.names) > WORDS:
                        old, words = words, Words()
                        numbers = words.of(lang)
                        before = np.array([numbers[old.names[w]] if w else 0 for w in before], dtype=np.int64)
                tokens = np.fromiter(map(numbers.__getitem__, slab), dtype=np.int64, count=len(slab))
                run += [before, tokens]
                own += [np.zeros(len(before), dtype=bool), np.ones(len(tokens), dtype=bool)]
                before = np.concatenate([before, tokens[-LONGEST:]])[1 - LONGEST :]
                size += len(before) + len(tokens)
            run.append(np.append(before, 0))  # the end of the text
            own.append(np.append(np.zeros(len(before), dtype=bool), True))
    if run:
        yield from stripes(words, np.concatenate(run), np.concatenate(own), level, bits, hot)


def merged(docs: DataFrame, level: int, bits: list[np.ndarray], hot: dict[tuple[str, str], int]) -> DataFrame:
    """(lang, prefix, segment, next, f): the elements of the merged stripes."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    found = docs.mapInArrow(lambda batches: counted(batches, level, shared.value, hot), STRIPE)
    together = found.repartition("lang", "prefix", "segment").select("lang", "prefix", "segment", F.inline(F.arrays_zip(F.col("next").alias("next"), F.col("counts").alias("counts"))))
    # The exchange above already brings equal keys together, so this sum needs none of its own.
    return together.groupBy("lang", "prefix", "segment", "next").agg(F.sum("counts").alias("f"))


def bits_for(n: int) -> int:
    """Size of the bit array of ``n`` hashes, a power of two: 16 bits for each, MOST_BITS at most."""
    return min(MOST_BITS, max(1 << 16, 1 << (16 * max(n, 1) - 1).bit_length()))


def set_bits(found: DataFrame, size: int) -> np.ndarray:
    """The bit array of these places, which count from 1."""
    rows = found.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for row in rows.collect():  # size / 32768 rows of 4 KB
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)[: len(out)]
    return out


def bit_array(phrases: DataFrame, n: int) -> np.ndarray:
    """A bit for the hash of every (lang, phrase), MOST_BITS at most."""
    size = bits_for(n)
    shift = 64 - (size.bit_length() - 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([(phrase_hash(a, b) >> shift) + 1 for a, b in zip(*(c.to_pylist() for c in batch.columns))], pa.int64())], names=["place"])

    return set_bits(phrases.select("lang", "phrase").mapInArrow(places, "place long"), size)


def exact(value) -> F.Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``first`` phrases of 2 to 4 words of each language, of those that occur ``least`` times.

    ``docs`` has (lang, text); other columns are not read. A null language is ``und``, null and empty texts have no words, repeated rows count as
    often as they occur. A very long text is split slab by slab, with its last words carried over. Of the cuts of a phrase into two the one with
    the lowest score counts, of equal ones the first; equal scores go by count, then by the phrase's bytes. An empty table gives no rows."""
    spark = docs.sparkSession
    # Single-word phrases: count of each frequent word; ``ls`` and ``rs`` are the counts of the proper first and last parts of a phrase.
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bits: list[np.ndarray] = []
    hot: dict[tuple[str, str], int] = {}
    levels: list[DataFrame] = []
    covers: list[DataFrame] = []
    n, share = None, 0
    for level in range(1, LONGEST + 1):
        elements = merged(texts, level, bits, hot)
        if level == 1:
            # The one stripe whose rare elements count: they are lumped under no word, so that what is written stays small.
            kept = F.when(F.col("f") >= least, F.col("next")).otherwise("")
            elements = elements.groupBy("lang", "prefix", kept.alias("next")).agg(F.sum("f").alias("f"))
        else:
            elements = elements.filter(F.col("f") >= least)
        elements = cut(elements.select("lang", "prefix", "next", "f"), f"stripes{level}")
        found = elements.filter("next <> ''")
        if level == 1:
            n = cut(elements.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
            share = max(1, -(-(n.agg(F.sum("n")).first()[0] or 0) // SEGMENTS))
            none = F.array().cast("array<long>")
            found = found.select("lang", F.col("next").alias("phrase"), "f", F.lit("").alias("suffix"), none.alias("ls"), none.alias("rs"))
        else:
            shorter = levels[-1]
            begins = shorter.select("lang", F.col("phrase").alias("prefix"), F.concat("ls", F.array("f")).alias("ls"))
            suffix = F.concat_ws(" ", F.substring_index("prefix", " ", -(level - 2)), "next") if level > 2 else F.col("next")
            found = found.withColumn("suffix", suffix).join(begins, ["lang", "prefix"])
            ends = shorter.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("f"), "rs").alias("rs"))
            found = found.join(ends, ["lang", "suffix"]).select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), "f", "suffix", "ls", "rs")
        levels.append(cut(found, f"phrases{level}"))
        if level > 2:
            covers += [elements.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("f").alias("most")), levels[-1].select("lang", F.col("suffix").alias("phrase"), F.col("f").alias("most"))]
        size = levels[-1].count()
        if level == LONGEST or not size:
            break
        bits.append(bit_array(levels[-1], size))
        # Phrases of one length share all words, so no more than SEGMENTS of them hold a SEGMENTS-th each.
        hot = {(r["lang"], r["phrase"]): -(-r["f"] // share) for r in levels[-1].filter(F.col("f") > share).select("lang", "phrase", "f").collect()}
    if len(levels) < 2:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    candidates = levels[1]
    for more in levels[2:]:
        candidates = candidates.unionByName(more)
    if covers:
        cover = covers[0]
        for more in covers[1:]:
            cover = cover.unionByName(more)
        cover = cover.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
        candidates = candidates.join(cover, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (exact("most") * 100 < exact("f") * COVER))
    cuts = F.transform(F.arrays_zip("ls", "rs"), lambda c, i: F.struct(F.expr(f"CAST({FACTOR} AS DECIMAL(7,0)) * CAST(f AS DECIMAL(20,0))").alias("p"), (exact(c["ls"]) + exact(c["rs"])).alias("q"), i.alias("i"), c["ls"].alias("l"), c["rs"].alias("r")))
    scores = F.transform(cuts, lambda c: F.struct(F.floor(c["p"] / c["q"]).alias("score"), c["i"].alias("i"), c["l"].alias("l"), c["r"].alias("r")))
    scored = candidates.select("lang", "phrase", F.col("f").alias("a"), F.array_min(scores).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM lists),
runs AS MATERIALIZED (SELECT lang, w1, {", ".join(f"lead(w1, {m - 1}) OVER o AS w{m}" for m in range(2, LONGEST + 1))} FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS MATERIALIZED ({" UNION ALL ".join(f"SELECT lang, {m} AS m, {" || ' ' || ".join(f'w{i}' for i in range(1, m + 1))} AS phrase, count(*)::BIGINT AS f FROM runs WHERE w{m} IS NOT NULL GROUP BY ALL" for m in range(1, LONGEST + 1))}),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, phrase, m, a, w, unnest(range(1, m)) AS k FROM c),
scored AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, ({FACTOR}::HUGEINT * x.a) // (l.f + r.f) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, w, m, a, unnest(range(2, m)) AS size FROM c WHERE m > 2),
inside AS (SELECT lang, a, size, w, unnest(range(1, m - size + 2)) AS i FROM parts),
cover AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS most FROM inside GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score::BIGINT AS score
FROM lowest b LEFT JOIN cover v ON v.lang = b.lang AND v.phrase = b.phrase JOIN n ON n.lang = b.lang
WHERE most IS NULL OR 100::HUGEINT * most < {COVER}::HUGEINT * a QUALIFY rank <= {FIRST}"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
