"""Quality rules: hard text statistics, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed n-grams are compared: the trusted target (documents labelled as good) and the raw corpus (every
document). A document's score is the mean of ``log p_target - log p_raw`` over its n-grams, and it is kept where the score
reaches a fixed threshold. The n-grams are all whole words and all pairs of neighbouring words, the last one with the end of the text.
Both counts of an n-gram, the raw one scaled to the target's size, are smoothed by the same number, so that a rare but ordinary word costs a
document little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from joulemill.llm.registry import query, table
from joulemill.llm.words import BLANKS, bind, words

BUCKETS = 262_144  # hash values of an n-gram; also the bound on what is broadcast
SMOOTH = 5.0  # added to both counts of an n-gram
TRUSTED_ROWS = 20_000  # bound on the labelled documents that make the target
THRESHOLD = -0.15  # mean log-likelihood ratio, in nats per n-gram
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``rows`` ids of documents labelled as good and never as bad, chosen by hash."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def with_buckets(df: DataFrame) -> DataFrame:
    """Adds ``_w`` (words), ``_h`` (their hashes) and ``_b`` (hashed n-grams) from ``text``. A word is hashed once, a pair from the hashes of its words."""
    df = bind(df, _w=words(F.col("text")))
    df = bind(df, _h=F.transform("_w", lambda w: F.xxhash64(w)))
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    pairs = F.transform("_h", lambda h, i: bucket(F.xxhash64(h, F.get("_h", i + 1))))
    return bind(df, _b=F.concat(F.transform("_h", bucket), pairs))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row ``weights array<double>``: the log ratio of each bucket. All documents are counted; ``trusted`` is
    bounded (see ``trusted_ids``), so its broadcast is too, and counts are combined before the only shuffle."""
    spark = docs.sparkSession
    flag = F.broadcast(trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_t")))
    marked = docs.select("doc_id", "text").join(flag, F.col("doc_id") == F.col("_id"), "left")
    grams = with_buckets(marked).select("_t", F.explode_outer("_b").alias("b")).filter("b is not null")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_t").alias("target"))
    table = spark.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0, ["raw", "target"])
    cells = table.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"), F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("cells"))
    expected = lambda x: F.coalesce(x["raw"] * (F.col("n_target") / F.when(F.col("n_raw") > 0, F.col("n_raw"))), F.lit(0.0))
    ratio = lambda x: F.log((x["target"] + SMOOTH) / (expected(x) + SMOOTH))
    return cells.select(F.transform("cells", ratio).alias("weights"))


def exact_repeats(w: Column) -> Column:
    """Places of the three-word windows that are found more than once, by sorting the windows themselves."""
    windows = F.transform(w, lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("at")))
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    ordered = F.array(F.sort_array(F.filter(windows, lambda x: x["c"].isNotNull())))
    repeated = F.transform(ordered, lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1))))
    return F.transform(F.get(repeated, F.lit(0)), lambda x: x["at"])


def statistics(df: DataFrame) -> DataFrame:
    """Adds the text statistics to rows with ``_w`` and ``_h``. Repeated windows are found by sorting (hash of three words, place), packed into one long with as many bits
    for the place as the text needs: a window is repeated when a neighbour in that order has the same hash. Words of neighbours with equal
    hashes are compared; a text where they differ anywhere is sorted by the words themselves. Covered words are counted over the gaps between
    repeated windows. The two cut windows at the end of the text are equal to none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    shift = lambda name, x: F.call_function(name, x, F.col("_bits"))
    df = bind(df, _bits=F.length(F.bin(F.size("_w"))), _l=F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    window = lambda h, i: shift("shiftleft", F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2))).bitwiseOR(i.cast("long"))
    df = bind(df, _g=F.sort_array(F.transform("_h", window)))
    place = lambda x: x.bitwiseAND(shift("shiftleft", F.lit(1).cast("long")) - 1)
    alike = lambda x, name, k: shift("shiftrightunsigned", x.bitwiseXOR(F.get(name, k))) == 0
    df = bind(df, _q=F.filter("_g", lambda x, k: alike(x, "_g", k + 1) | alike(x, "_g", k - 1)))
    word = lambda x, d: F.get("_w", (place(x) + d).cast("int"))
    differ = lambda x, y: ~(word(x, 0).eqNullSafe(word(y, 0)) & word(x, 1).eqNullSafe(word(y, 1)) & word(x, 2).eqNullSafe(word(y, 2)))
    clash = F.size(F.filter("_q", lambda x, k: alike(x, "_q", k + 1) & differ(x, F.get("_q", k + 1)))) > 0
    df = bind(df, _r=F.sort_array(F.when(clash, exact_repeats(F.col("_w"))).otherwise(F.transform("_q", place))))
    gaps = F.transform("_r", lambda i, k: F.least(F.lit(3).cast("long"), F.get("_r", k + 1) - i))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    ).drop("_bits", "_g", "_q", "_r", "_l")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with its statistics, ``score``, ``base_failed`` and ``kept``.

    Null and empty texts have no words: all counts 0, ``score`` 0, ``base_failed``; long texts are read whole. Rows are judged one by one, so
    repeated rows and repeated ids get the same verdict; other columns pass through, whatever their names, but for those named like an added
    one, which are replaced. Without labels (or with null ids only) the target is empty and no n-gram speaks for or against a
    document. An empty table gives an empty one."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    model = weights(docs, trusted_ids(labels))
    rest = [c for c in docs.columns if c.lower() not in added]
    df = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in rest if c != "text"]).alias("_row"))  # no name of theirs can clash
    df = statistics(with_buckets(df)).withColumn("_m", model.scalar())
    total = F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get("_m", b))
    df = bind(df, score=F.coalesce(total / F.when(F.size("_b") > 0, F.size("_b")), F.lit(0.0)))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return df.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in rest], *added)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels")).select(COLUMNS)
