"""Streaming queries over the events, documents and conversations tables."""

from __future__ import annotations

import decimal
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from joulemill.carbon import accounting as acc
from joulemill.operators.exact import exact_sum, joined, piece_sums
from joulemill.registry import query
from joulemill.storage import cut, gathered, scratch
from joulemill.streaming import sessions
from joulemill.streaming.models import learned, version
from joulemill.streaming.panes import window_reduce
from joulemill.streaming.run import completed, drain, drain_batches, drain_numbers, drain_until_idle, event_stream, table_stream, upserted

STAMP = "yyyy-MM-dd HH:mm:ss"
CONV_WORDS = r"(SELECT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM conversations)"


def word_stream(t, name="conversations"):
    return table_stream(t, name).select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")


@query("st_01_word_count", "ST-01 ST-06 ST-21 STM-03 STM-06 STM-10 STM-14 STM-15", f"SELECT word, count(*) AS n FROM {CONV_WORDS} WHERE word <> '' GROUP BY 1")
def word_count(t):
    """The same plan serves a message-queue source: only the reader's format changes."""
    return completed(word_stream(t).groupBy("word").agg(F.count("*").alias("n")))


SLIDE = "FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS b, * FROM events), range(0, 3) r(i)"


@query("st_02_sliding_counts", "ST-02 ST-14 DS-03 STM-01", f"SELECT strftime(b - to_hours(2 * i), '%Y-%m-%d %H:%M:%S') AS start, event_type AS word, count(*) AS n {SLIDE} GROUP BY ALL")
def sliding_counts(t):
    w = event_stream(t).groupBy(F.window("ts", "6 hours", "2 hours"), F.col("event_type").alias("word")).agg(F.count("*").alias("n"))
    out = drain(w.select("window.start", "word", "n"))
    return out.filter("word <> 'end'").select(F.date_format("start", STAMP).alias("start"), "word", "n")


@query("ds_03_window_reduce", "DS-03 ST-14", f"SELECT strftime(b - to_hours(2 * i), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(fsum(value), 4) AS total {SLIDE} GROUP BY ALL")
def reduce_by_window(t):
    """Totals per event type over six hours, every two hours: the entering pane is added, the leaving one subtracted."""
    out = drain(window_reduce(event_stream(t, delay=None), "10 minutes", ["event_type"], {"total": F.col("value")}, 6 * 3_600_000, 2 * 3_600_000))
    return out.filter("event_type <> 'end'").select(F.date_format("start", STAMP).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ds_03_count_by_value", "DS-03", f"SELECT strftime(b - to_hours(2 * i), '%Y-%m-%d %H:%M:%S') AS start, floor(value / 20)::BIGINT AS value, count(*) AS n {SLIDE} GROUP BY ALL")
def count_by_value_and_window(t):
    stream = event_stream(t, delay=None).select("ts", F.when(F.col("user_id") >= 0, F.floor(F.col("value") / 20)).otherwise(-99).cast("long").alias("value"))
    out = drain(window_reduce(stream, "10 minutes", ["value"], {}, 6 * 3_600_000, 2 * 3_600_000))
    return out.filter("value <> -99").select(F.date_format("start", STAMP).alias("start"), "value", "n")


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
s AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM i GROUP BY user_id, sid)"""


@query("st_03_session_windows", "ST-03", SESSIONS + "SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, (epoch_us(z) - epoch_us(a)) // 1000 + 1800000 AS duration_ms, n FROM s")
def session_windows(t):
    """Sessions are merged inside each input partition first, so a hot user ships sessions, not events."""
    t.spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    w = event_stream(t).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    out = drain(w.select("user_id", F.col("session_window.start").alias("a"), F.col("session_window.end").alias("z"), "n"))
    ms = F.floor((F.unix_micros("z") - F.unix_micros("a")) / 1000)
    return out.select("user_id", F.date_format("a", STAMP).alias("start"), ms.alias("duration_ms"), "n")


@query("st_04_session_state", "ST-04 STM-20 STM-21 DS-06", """WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events),
g AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < 1800000 THEN 0 ELSE 1 END AS new FROM m), i AS (SELECT user_id, ms, sum(new) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n FROM i GROUP BY user_id, sid""")
def session_state(t):
    return drain(sessions.gap_sessions(event_stream(t, delay=None), "user_id", 1_800_000, "10 minutes")).filter("user_id >= 0")


@query("st_04_processing_timeout", "ST-04 STM-20 STM-21", """WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events),
g AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < 1800000 THEN 0 ELSE 1 END AS new FROM m), i AS (SELECT user_id, ms, sum(new) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n, max(ms) + 2400000 > max(max(ms)) OVER (PARTITION BY user_id) AS timed_out FROM i GROUP BY user_id, sid""")
def processing_timeout(t):
    """Sessions closed by later events, and those that only a timer of two seconds without input closes."""
    return drain_until_idle(sessions.idle_sessions(table_stream(t, "events"), "user_id", 1_800_000, 600_000, 2_000))


@query("st_05_two_condition_sessions", "ST-05", """
WITH g AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS p, lag(event_type) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 1800000000 OR k = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
s AS (SELECT user_id, min(us) AS start_us, max(us) + CASE WHEN arg_max(event_type, (us, event_id)) = 'purchase' THEN 0 ELSE 1800000000 END AS end_us, count(*) AS n FROM i GROUP BY user_id, sid)
SELECT user_id, start_us, end_us - start_us AS duration_us, n FROM s WHERE end_us < (SELECT max(epoch_us(ts)) - 600000000 FROM events)""")
def two_condition_sessions(t):
    out = sessions.two_condition_sessions(table_stream(t, "events"), 1_800_000_000, 600_000_000, "purchase")
    return out.select("user_id", "start_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n")


SCORES = r"""scores AS (SELECT word, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END)::BIGINT AS score FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents) JOIN labels USING (doc_id) WHERE word <> '' GROUP BY 1)"""


@query("st_07_weighted_words", "ST-07 DS-05 JN-16", f"""
WITH {SCORES}, c AS (SELECT word, count(*) AS n FROM {CONV_WORDS} WHERE word <> '' GROUP BY 1) SELECT word, n * score AS weight FROM c JOIN scores USING (word) ORDER BY weight DESC, word LIMIT 5""")
def weighted_words(t):
    """Stream joined with a static word table (its scores come from the labelled documents); weights add up over the batches, and the report takes the
    top five of the totals, however the stream was cut into batches."""
    w = t.documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).filter("word <> ''")
    scores = cut(w.join(t.labels, "doc_id").groupBy("word").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(-1)).alias("score")), "scores")

    def weigh(batch):
        counts = batch.groupBy("word").agg(F.count("*").alias("n"))
        return counts.join(scores, "word").select("word", (F.col("n") * F.col("score")).alias("weight"))

    totals = drain_batches(word_stream(t), "append", weigh).groupBy("word").agg(F.sum("weight").alias("weight"))
    return totals.orderBy(F.desc("weight"), "word").limit(5)


@query("st_08_initial_state", "ST-08", f"SELECT word, count(*) AS n FROM (SELECT word FROM {CONV_WORDS} WHERE word <> '' UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part) GROUP BY 1")
def initial_state(t):
    """The initial counts enter the stream as its first rows, so the running aggregate starts from them."""
    first = table_stream(t, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return completed(word_stream(t).union(first).groupBy("word").agg(F.count("*").alias("n")))


@query("st_09_recoverable_count", "ST-09 ST-11 ST-12 DS-07 DS-08", f"""
SELECT CASE WHEN word IN ('the', 'de', 'and') THEN 'dropped' ELSE 'kept' END AS kind, count(*) AS n FROM {CONV_WORDS} WHERE word <> '' GROUP BY 1""")
def recoverable_count(t):
    """Two arrivals of files, a stop in between, one checkpoint: the restarted query goes on where it was."""
    spark = t.spark
    source, sink = scratch(spark, "arrivals"), scratch(spark, "recoverable")
    halves = [t.conversations.filter(F.col("conv_id") % 2 == i) for i in (0, 1)]
    stopped = F.col("word").isin("the", "de", "and")

    def write(batch, number):
        batch.groupBy(F.when(stopped, "dropped").otherwise("kept").alias("kind")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    for half in halves:
        half.write.mode("append").parquet(source)
        words = spark.readStream.schema(half.schema).option("maxFilesPerTrigger", 4).parquet(source).select(
            F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")
        words.writeStream.foreachBatch(write).option("checkpointLocation", sink + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).groupBy("kind").agg(F.sum("n").alias("n"))


@query("st_10_sql_per_batch", "ST-10 ST-13 DS-02", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def sql_per_batch(t):
    def report(batch):
        batch.createOrReplaceTempView("joulemill_batch")
        return batch.sparkSession.sql("SELECT event_type, count(*) AS n, sum(value) AS total FROM joulemill_batch GROUP BY event_type")

    rows = drain_batches(table_stream(t, "events"), "append", report)
    return rows.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("st_11_queue_of_batches", "ST-11 ST-21", "SELECT o_orderkey % 10 AS remainder, count(*) AS n, 5 AS batches FROM orders GROUP BY 1")
def queue_of_batches(t):
    """Five files of keys arrive; a trigger takes one of them, and every batch is counted by its remainder of ten."""
    source = scratch(t.spark, "queue")
    t.orders.select("o_orderkey").repartition(5).write.parquet(source)
    stream = t.spark.readStream.schema("o_orderkey long").option("maxFilesPerTrigger", 1).parquet(source)
    counts = drain_batches(stream, "append", lambda b: b.groupBy((F.col("o_orderkey") % 10).alias("remainder")).agg(F.count("*").alias("n")))
    batches = counts.agg(F.count_distinct("batch").cast("int").alias("batches"))  # one row
    return counts.groupBy("remainder").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(batches))


@query("st_21_rate_lookup", "ST-21", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def rate_lookup(t):
    """The generated source stands in for a message queue: its numbers are order keys, which each batch looks up in the table."""
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    most = orders.agg(F.max("o_orderkey")).first()[0] or 0
    stream = t.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", most // 3 + 1).load()
    found = stream.join(orders, stream.value == orders.o_orderkey).select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows = drain_numbers(found, most // 3 + 1, most)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("st_15_error_rate", "ST-15", f"""
SELECT strftime(b - to_hours(2 * i), '%Y-%m-%d %H:%M:%S') AS start, user_id % 5 AS zone, round(avg((event_type = 'error')::INT), 6) AS rate, avg((event_type = 'error')::INT) > 0.25 AS flagged {SLIDE} GROUP BY ALL""")
def error_rate(t):
    zone = F.when(F.col("user_id") >= 0, F.col("user_id") % 5).otherwise(-1).alias("zone")
    w = event_stream(t).groupBy(F.window("ts", "6 hours", "2 hours"), zone).agg(F.avg((F.col("event_type") == "error").cast("int")).alias("rate"))
    out = drain(w.select("window.start", "zone", "rate")).filter("zone >= 0")
    return out.select(F.date_format("start", STAMP).alias("start"), "zone", F.round("rate", 6).alias("rate"), (F.col("rate") > 0.25).alias("flagged"))


@query("st_16_active_users", "ST-16 STM-02", f"SELECT strftime(b - to_hours(2 * i), '%Y-%m-%d %H:%M:%S') AS start, count(DISTINCT user_id) AS users {SLIDE} GROUP BY 1")
def active_users(t):
    """Distinct keys per window in two steps: the stream keeps each (window, user) once, the report counts them."""
    once = event_stream(t).select(F.window("ts", "6 hours", "2 hours").alias("w"), "user_id", "ts").dropDuplicates(["w", "user_id"])
    pairs = drain(once.select("w.start", "user_id"))
    return pairs.filter("user_id >= 0").groupBy(F.date_format("start", STAMP).alias("start")).agg(F.count("*").alias("users"))


@query("st_17_known_users", "ST-17", "SELECT DISTINCT user_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE c_acctbal > 0 ORDER BY user_id LIMIT 10")
def known_users(t):
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    seen = table_stream(t, "events").select("user_id").join(known, "user_id")
    return drain_batches(seen, "append", lambda b: b.distinct()).select("user_id", "c_name").distinct().orderBy("user_id").limit(10)


def student_p(t_value, df):
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t_value * t_value), df / 2.0, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d) if abs(1 + num * d) > 1e-300 else 1e300
        c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    p = front * (f - 1)
    return 1 - p if swap else p


@query("st_18_significance", "ST-18", """
WITH g AS (SELECT user_id % 2 AS arm, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1)
SELECT a.n + b.n AS n, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 3) AS df, true AS p_valid FROM g a JOIN g b ON a.arm = 0 AND b.arm = 1""")
def significance(t):
    """Welch test of two arms on a stream. Batches add (n, sum, sum of squares); batches of a peace period
    can be skipped and the test held to a window of the last batches; the query takes all batches."""
    return welch(table_stream(t, "events"), peace=0)


def welch(stream, peace, window=None):
    x = F.col("value") - 50.0  # shifted so that squares stay small
    moments = lambda b: b.groupBy((F.col("user_id") % 2).alias("arm")).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    rows = drain_batches(stream, "append", moments)
    used = rows.filter(F.col("batch") >= peace)
    if window is not None:
        last = rows.agg(F.max("batch").alias("_last"))
        used = used.crossJoin(F.broadcast(last)).filter(F.col("batch") > F.col("_last") - window)
    arms = used.groupBy("arm").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    arms = arms.select("arm", "n", (F.col("s") / F.col("n")).alias("m"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"))
    a, b = arms.filter("arm = 0").toDF("x0", "na", "ma", "va"), arms.filter("arm = 1").toDF("x1", "nb", "mb", "vb")
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    stat = a.crossJoin(b).select((F.col("na") + F.col("nb")).alias("n"), ((F.col("ma") - F.col("mb")) / F.sqrt(ea + eb)).alias("t"),
                                 (F.pow(ea + eb, F.lit(2)) / (F.pow(ea, F.lit(2)) / (F.col("na") - 1) + F.pow(eb, F.lit(2)) / (F.col("nb") - 1))).alias("df"))

    @F.pandas_udf("double")
    def p_value(tv: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([student_p(x, y) for x, y in zip(tv, dfs)])

    return stat.withColumn("p", p_value("t", "df")).select("n", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.col("p").between(0, 1).alias("p_valid"))


K, DECAY = 4, 0.9
NEAREST = f"""seeds AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS centre, embedding::DOUBLE[] AS place FROM embeddings QUALIFY centre < {K}),
near AS (SELECT vec_id, any_value(e.embedding::DOUBLE[]) AS v, arg_min(centre, (list_distance(e.embedding::DOUBLE[], place), centre)) AS centre FROM embeddings e CROSS JOIN seeds GROUP BY vec_id),
sums AS (SELECT centre, d, sum(x) AS s, count(*) AS n FROM (SELECT centre, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near) GROUP BY ALL),
moved AS (SELECT a.centre, d, coalesce(s / n, x) AS x, coalesce(n, 0) AS n FROM (SELECT centre, unnest(place) AS x, generate_subscripts(place, 1) AS d FROM seeds) a LEFT JOIN sums USING (centre, d))"""


def first_centres(vectors, k):
    """The k rows with the smallest ids, without weight."""
    rows = vectors.orderBy("vec_id").limit(k).select(F.col("embedding").cast("array<double>").alias("place")).collect()
    return vectors.sparkSession.createDataFrame([(i, 0.0, r["place"]) for i, r in enumerate(rows)], "centre int, weight double, place array<double>")


def move_centres(model, batch, decay=DECAY):
    """Old weights decay, the batch adds its sums: one partial sum per partition, added exactly, so that a repeated batch gives the same bits."""
    rows = sorted(model.collect())  # k rows
    if not rows:
        return model
    numbers, places = [r["centre"] for r in rows], np.array([r["place"] for r in rows])

    def assign(batches):
        total, count = np.zeros_like(places), np.zeros(len(places), dtype=int)
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float)
                near = ((x[:, None, :] - places[None]) ** 2).sum(2).argmin(1)
                np.add.at(total, near, x)
                np.add.at(count, near, 1)
        for i in np.flatnonzero(count):
            yield pa.RecordBatch.from_pydict({"centre": pa.array([numbers[i]] * total.shape[1], pa.int32()), "d": pa.array(range(total.shape[1]), pa.int32()), "s": total[i], "n": pa.array([count[i]] * total.shape[1], pa.int64())})

    sums = batch.select("embedding").mapInArrow(assign, "centre int, d int, s double, n long").groupBy("centre", "d").agg(exact_sum("s").alias("s"), F.sum("n").alias("n"))
    old = model.select("centre", "weight", F.posexplode("place").alias("d", "x")).join(sums, ["centre", "d"], "left")
    held, n = F.col("weight") * decay, F.coalesce("n", F.lit(0))
    moved = old.withColumn("x", F.when(held + n > 0, (F.col("x") * held + F.coalesce("s", F.lit(0.0))) / (held + n)).otherwise(F.col("x"))).withColumn("weight", held + n)
    return moved.groupBy("centre").agg(F.max("weight").alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("place"))


@query("st_19_streaming_kmeans", "ST-19", f"WITH {NEAREST} SELECT centre::INTEGER AS centre, any_value(n)::DOUBLE AS weight, round(sqrt(sum(x * x)), 6) AS norm FROM moved GROUP BY 1")
def streaming_kmeans(t):
    """Centres move with every batch; version b of the model is the table that batch b has written."""
    first = first_centres(t.embeddings, K)
    root, last = learned(table_stream(t, "embeddings"), first, move_centres)
    norm = F.sqrt(F.aggregate("place", F.lit(0.0), lambda a, x: a + x * x))
    return version(t.spark, root, last, first.schema).select("centre", "weight", F.round(norm, 6).alias("norm"))


STEPS, RATES = 10, (0.5, 1.0)
DESCENT = ",\n".join(["""p AS MATERIALIZED (SELECT (l_quantity - 25.5) / 14.4 AS x, l_extendedprice / 50000 - 1 AS y, (l_extendedprice > 40000)::INTEGER::DOUBLE AS z FROM lineitem),
w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d)""", *[f"""w{i + 1} AS MATERIALIZED (SELECT any_value(a) - {RATES[0]} * sum(a + b * x - y) / count(*) AS a, any_value(b) - {RATES[0]} * sum((a + b * x - y) * x) / count(*) AS b,
any_value(c) - {RATES[1]} * sum(1 / (1 + exp(-(c + d * x))) - z) / count(*) AS c, any_value(d) - {RATES[1]} * sum((1 / (1 + exp(-(c + d * x))) - z) * x) / count(*) AS d FROM p CROSS JOIN w{i})""" for i in range(STEPS)]])


PIECES = "value int, rows long, top decimal(38,0), units decimal(38,0), low decimal(38,0), lowest decimal(38,0), beyond double"


def gradient_sums(points, w):
    """Number of points and the sums of both models' misses, plain and by x: one row of exact partial sums per value and task, so any partitioning gives the same bits."""
    (a, b), (c, d) = w["linear"], w["logistic"]

    def added(batches):
        rows, sums = 0, [[0, 0, 0, 0, 0.0] for _ in range(4)]
        for batch in batches:
            x, y, z = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            with np.errstate(over="ignore", invalid="ignore"):
                miss, off = a + b * x - y, 1 / (1 + np.exp(-(c + d * x))) - z
                found = [piece_sums(v) for v in (miss, miss * x, off, off * x)]
            rows, sums = rows + batch.num_rows, [[p + q for p, q in zip(old, new)] for old, new in zip(sums, found)]
        whole = [pa.array([decimal.Decimal(s[i]) for s in sums], pa.decimal128(38, 0)) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array([rows] * 4, pa.int64()), *whole, pa.array([s[4] for s in sums])], ["value", "rows", "top", "units", "low", "lowest", "beyond"])

    pieces = points.select("x", "y", "z").mapInArrow(added, PIECES).groupBy("value").agg(F.sum("rows").alias("n"), joined([F.sum(p) for p in ("top", "units", "low", "lowest", "beyond")]).alias("s"))
    rows = sorted(pieces.collect())  # four rows, none if there is no point
    return [rows[0]["n"], *[r["s"] for r in rows]] if rows else [0]


def descend(model, batch, steps=STEPS):
    """Gradient steps of a linear and a logistic model on the batch; each step is one small exact aggregate."""
    spark = batch.sparkSession
    x = (F.col("l_quantity") - 25.5) / 14.4
    points = cut(batch.select(x.alias("x"), (F.col("l_extendedprice") / 50000 - 1).alias("y"), (F.col("l_extendedprice") > 40000).cast("double").alias("z")).dropna(), "points")
    w = {r["model"]: (r["intercept"], r["slope"]) for r in model.collect()}  # two rows
    for _ in range(steps):
        (a, b), (c, d) = w["linear"], w["logistic"]
        g = gradient_sums(points, w)
        if not g[0]:
            break
        w = {"linear": (a - RATES[0] * g[1] / g[0], b - RATES[0] * g[2] / g[0]), "logistic": (c - RATES[1] * g[3] / g[0], d - RATES[1] * g[4] / g[0])}
    return spark.createDataFrame([(k, *v) for k, v in w.items()], "model string, intercept double, slope double")


@query("st_20_streaming_regression", "ST-20", f"WITH {DESCENT} SELECT 'linear' AS model, round(a, 6) AS intercept, round(b, 6) AS slope FROM w{STEPS} UNION ALL SELECT 'logistic', round(c, 6), round(d, 6) FROM w{STEPS}")
def streaming_regression(t):
    first = t.spark.createDataFrame([("linear", 0.0, 0.0), ("logistic", 0.0, 0.0)], "model string, intercept double, slope double")
    root, last = learned(table_stream(t, "lineitem").select("l_quantity", "l_extendedprice"), first, descend)
    return version(t.spark, root, last, first.schema).select("model", F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"))


@query("ds_07_text_slice", "DS-07", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts::DATE BETWEEN (SELECT min(ts)::DATE + 3 FROM events) AND (SELECT min(ts)::DATE + 9 FROM events) GROUP BY ALL""")
def text_slice(t):
    """Every batch is saved as text in a folder of its own, by day; a slice reads the days between two dates and no others."""
    root = scratch(t.spark, "text")

    def save(batch, number):
        lines = batch.select(F.to_date("ts").alias("day"), F.concat_ws("|", F.date_format("ts", STAMP), "event_type", F.col("event_id").cast("string")).alias("value"))
        gathered(lines, "day").write.mode("overwrite").partitionBy("day").text(f"{root}/events-{number}.txt")

    table_stream(t, "events").writeStream.foreachBatch(save).option("checkpointLocation", root + "-state").trigger(availableNow=True).start().awaitTermination()
    saved = t.spark.read.schema("value string, day date").option("basePath", root).option("recursiveFileLookup", False).text(f"{root}/events-*.txt")
    first = t.events.agg(F.to_date(F.min("ts"))).first()[0]
    between = saved.filter(F.col("day").between(F.date_add(F.lit(first), 3), F.date_add(F.lit(first), 9)))
    return between.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), F.split_part("value", F.lit("|"), F.lit(2)).alias("event_type")).agg(F.count("*").alias("n"))


@query("st_22_dedup", "ST-22 STM-02", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def dedup(t):
    """Every event arrives three times; repeats inside the watermark are dropped."""
    thrice = event_stream(t, closed=False).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    once = drain(thrice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"))
    return once.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def purchases_and_views(t):
    """Two streams with watermarks and the condition that bounds the state of both: a purchase and the views of two hours before."""
    p = event_stream(t).filter("event_type IN ('purchase', 'end')").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts"))
    v = event_stream(t).filter("event_type IN ('view', 'end')").select(F.col("event_id").alias("seen"), F.col("user_id").alias("v_user"), F.col("ts").alias("v_ts"))
    return p, v, F.expr("p_user = v_user AND v_ts BETWEEN p_ts - INTERVAL 2 HOURS AND p_ts")


SIDES = """WITH p AS (SELECT event_id AS purchase, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS seen, user_id, ts FROM events WHERE event_type = 'view')"""
NEAR = "p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 2 HOUR AND p.ts"


def outer_rows(t, how):
    """Rows of an outer stream join with -1 for the missing side. State of either side leaves with nulls when the watermark rules out a match; the
    closing row of the streams has the id -1 itself and matches only its like."""
    p, v, near = purchases_and_views(t)
    both = drain(p.join(v, near, how).select(F.coalesce("purchase", F.lit(-2).cast("long")).alias("purchase"), F.coalesce("seen", F.lit(-2).cast("long")).alias("seen")))
    rows = both.filter("purchase <> -1 AND seen <> -1")
    return rows.select(F.lit(how).alias("how"), *[F.greatest(c, F.lit(-1).cast("long")).alias(c) for c in ("purchase", "seen")])


@query("st_23_right_join", "ST-23 DS-04", f"{SIDES} SELECT 'right_outer' AS how, coalesce(purchase, -1) AS purchase, seen FROM p RIGHT JOIN v ON {NEAR}")
def right_stream_join(t):
    return outer_rows(t, "right_outer")


@query("st_23_full_join", "ST-23 DS-04", f"{SIDES} SELECT 'full_outer' AS how, coalesce(purchase, -1) AS purchase, coalesce(seen, -1) AS seen FROM p FULL JOIN v ON {NEAR}")
def full_stream_join(t):
    return outer_rows(t, "full_outer")


@query("st_23_semi_join", "ST-23 DS-04", f"{SIDES} SELECT purchase, user_id FROM p WHERE EXISTS (SELECT 1 FROM v WHERE {NEAR})")
def semi_stream_join(t):
    """Each purchase with at least one view in the two hours before it, once, however many views match and whichever side comes first."""
    p, v, near = purchases_and_views(t)
    return drain(p.join(v, near, "left_semi").select("purchase", F.col("p_user").alias("user_id"))).filter("purchase >= 0")


@query("st_23_stream_join", "ST-23 DS-04 JN-16", """
WITH p AS (SELECT event_id AS purchase, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS seen, user_id, ts FROM events WHERE event_type = 'view')
SELECT 'inner' AS how, purchase, seen FROM p JOIN v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 2 HOUR AND p.ts
UNION ALL SELECT 'left_outer', purchase, coalesce(seen, -1) FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 2 HOUR AND p.ts""")
def stream_join(t):
    """Purchases with the views of the two hours before, with state bounded by both watermarks and the time range."""
    out = None
    for how in ("inner", "left_outer"):
        p, v, near = purchases_and_views(t)
        part = drain(p.join(v, near, how).select(F.lit(how).alias("how"), "purchase", F.coalesce("seen", F.lit(-1).cast("long")).alias("seen"))).filter("purchase >= 0")
        out = part if out is None else out.union(part)
    return out


@query("ds_01_stateless", "DS-01", "SELECT event_id, upper(event_type) AS kind, round(value * 2, 4) AS twice, i FROM events, range(0, 2) r(i) WHERE value > 100")
def stateless(t):
    s = table_stream(t, "events").filter("value > 100").select("event_id", F.upper("event_type").alias("kind"), F.round(F.col("value") * 2, 4).alias("twice"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("i"))
    return drain(s)


@query("ds_06_running_totals", "DS-06 CO-27", """
WITH hours AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS ci FROM events GROUP BY 1), trace AS (SELECT hour, ci, row_number() OVER (ORDER BY hour) - 1 AS idx, count(*) OVER () AS n FROM hours),
o AS (SELECT min(ts) AS t0 FROM events) SELECT user_id AS job_id, count(*) AS samples, round(sum(ci) / 60, 6) AS carbon FROM events CROSS JOIN o JOIN trace ON idx = (5 + CAST(floor((epoch_us(ts) - epoch_us(t0)) / 60000000) AS BIGINT)) % n GROUP BY 1""")
def running_carbon(t):
    """The poll loop as a stream: samples meet the trace table, a running sum per job is upserted batch by batch."""
    priced = acc.price(acc.samples(table_stream(t, "events")), acc.hourly_trace(t.events))
    totals = priced.groupBy("job_id").agg(F.count("*").alias("samples"), (exact_sum("ci") / 60).alias("carbon"))
    return upserted(totals, ["job_id"]).select("job_id", "samples", F.round("carbon", 6).alias("carbon"))


@query("stm_04_formats", "STM-04 STM-05 STM-07 STM-08 STM-09", """
SELECT f AS format, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier CROSS JOIN (VALUES ('json'), ('orc'), ('csv'), ('text'), ('table')) v(f) GROUP BY 1""")
def formats(t):
    spark = t.spark
    s = t.supplier.select("s_suppkey", "s_name")
    out = None
    for fmt in ("json", "orc", "csv", "text", "table"):
        path = scratch(spark, fmt)
        if fmt == "table":
            name = "stream_" + path.rsplit("-", 1)[1]
            s.write.option("path", path).saveAsTable(name)
            stream = spark.readStream.table(name)
        elif fmt == "text":
            s.select(F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name").alias("value")).write.text(path)
            stream = spark.readStream.text(path).select(F.split_part("value", F.lit("|"), F.lit(1)).cast("long").alias("s_suppkey"))
        else:
            s.write.format(fmt).save(path)
            stream = getattr(spark.readStream.schema(s.schema), fmt)(path)
        part = drain(stream.select("s_suppkey")).agg(F.lit(fmt).alias("format"), F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))
        out = part if out is None else out.union(part)
    return out


@query("stm_11_sinks", "STM-11 STM-12 STM-16 STM-17", """
SELECT 'partitioned' AS sink, event_type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'table', event_type, count(*) FROM events GROUP BY ALL""")
def sinks(t):
    spark = t.spark
    path = scratch(spark, "partitioned")
    e = table_stream(t, "events").select("event_id", "event_type")
    q = e.writeStream.format("parquet").partitionBy("event_type").option("checkpointLocation", path + "-state").trigger(processingTime="0 seconds").start(path)
    q.processAllAvailable()
    q.stop()
    where = scratch(spark, "totable")
    name = "sink_" + where.rsplit("-", 1)[1]
    e.writeStream.option("checkpointLocation", where + "-state").option("path", where).trigger(availableNow=True).toTable(name).awaitTermination()
    first = spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit("partitioned").alias("sink"), "event_type", "n")
    return first.union(spark.table(name).groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit("table"), "event_type", "n"))


@query("stm_13_foreach_listener", "STM-13 STM-18 STM-19", "SELECT count(*) AS input_rows, true AS one_query FROM orders")
def foreach_listener(t):
    """A row writer that rejects bad rows, watched by a progress listener whose events become a metrics table."""
    class Check:
        def open(self, partition, epoch):
            return True

        def process(self, row):
            if row["o_totalprice"] < 0:
                raise ValueError("negative order")

        def close(self, error):
            return None

    progress: list[int] = []

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            progress.append(event.progress.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    spark, watch = t.spark, Watch()
    spark.streams.addListener(watch)
    try:
        spark.streams.resetTerminated()
        q = table_stream(t, "orders").select("o_orderkey", "o_totalprice").writeStream.foreach(Check()).option("checkpointLocation", scratch(spark, "foreach")).trigger(availableNow=True).start()
        spark.streams.awaitAnyTermination(600)
        q.awaitTermination()
        reported = sum(p["numInputRows"] for p in q.recentProgress)
    finally:
        spark.streams.removeListener(watch)
    return t.spark.range(1).select(F.lit(reported).cast("long").alias("input_rows"), F.lit(not spark.streams.active or q not in spark.streams.active).alias("one_query"))
