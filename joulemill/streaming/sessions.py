"""Session state machines on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from joulemill.operators.ordered import framed, running
from joulemill.storage import cut, scratch


def shrunk(events: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """(key, ts, start_ms, end_ms, n): events of a key folded into intervals within each input batch, so a hot key ships intervals."""
    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            pdf = pdf.sort_values([key, "ms"])
            k, ms = pdf[key].to_numpy(), pdf["ms"].to_numpy()
            new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (np.diff(ms) >= gap_ms)])
            last = np.r_[new[1:] - 1, len(ms) - 1]
            yield pd.DataFrame({key: k[new], "ts": pd.to_datetime(ms[last], unit="ms"), "start_ms": ms[new], "end_ms": ms[last], "n": last - new + 1})

    return events.select(key, F.unix_millis("ts").alias("ms")).mapInPandas(shrink, f"{key} long, ts timestamp, start_ms long, end_ms long, n long")


HELD = "starts array<long>, ends array<long>, counts array<long>"


def fold(held, chunks: Iterator[pd.DataFrame], gap_ms: int) -> list[list[int]]:
    """Open sessions of a key (start, end, count) with the new intervals merged in."""
    parts = [*map(tuple, held)]
    for pdf in chunks:
        parts += zip(pdf["start_ms"], pdf["end_ms"], pdf["n"])
    out: list[list[int]] = []
    for s, e, n in sorted(parts):
        if out and s - out[-1][1] < gap_ms:
            out[-1][1], out[-1][2] = max(out[-1][1], int(e)), out[-1][2] + int(n)
        else:
            out.append([int(s), int(e), int(n)])
    return out


def hold(state, sessions: list[list[int]]) -> None:
    state.update(tuple([int(v) for v in column] for column in zip(*sessions)))


def gap_sessions(events: DataFrame, key: str, gap_ms: int, delay: str) -> DataFrame:
    """Sessions by inactivity with hand-kept state and event-time timeouts (append mode).

    Events of a key (with ``ts``, no watermark yet) are folded before the shuffle; a key's state is its open sessions, not its events.
    """
    def step(k, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = fold(zip(*state.get) if state.exists else [], chunks, gap_ms)
        mark = state.getCurrentWatermarkMs()
        done = [h for h in held if h[1] + gap_ms <= mark]
        left = [h for h in held if h[1] + gap_ms > mark]
        if left:
            hold(state, left)
            state.setTimeoutTimestamp(min(h[1] for h in left) + gap_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(done), "start_ms": [h[0] for h in done], "end_ms": [h[1] for h in done], "n": [h[2] for h in done]})

    return shrunk(events, key, gap_ms).withWatermark("ts", delay).groupBy(key).applyInPandasWithState(
        step, f"{key} long, start_ms long, end_ms long, n long", HELD, "append", "EventTimeTimeout")


def idle_sessions(events: DataFrame, key: str, gap_ms: int, late_ms: int, idle_ms: int) -> DataFrame:
    """Sessions by inactivity that come out when a key has been quiet for ``idle_ms`` of processing time (append mode).

    A session that lies ``late_ms`` beyond the gap behind the key's newest event is final at once (``timed_out`` false). The others stay in the
    state, and every input of the key sets its timer anew; when the timer runs out they come out without any new row, and the state is removed.
    """
    def step(k, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [list(h) for h in zip(*state.get)] if state.exists else []
        timed_out = state.hasTimedOut
        if timed_out:
            done = held
            state.remove()
        else:
            held = fold(held, chunks, gap_ms)
            final = held[-1][1] - gap_ms - late_ms
            done = [h for h in held if h[1] <= final]
            hold(state, held[len(done):])
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [k[0]] * len(done), "start_ms": [h[0] for h in done], "end_ms": [h[1] for h in done], "n": [h[2] for h in done], "timed_out": [timed_out] * len(done)})

    return shrunk(events, key, gap_ms).groupBy(key).applyInPandasWithState(
        step, f"{key} long, start_ms long, end_ms long, n long, timed_out boolean", HELD, "append", "ProcessingTimeTimeout")


def number_sessions(events: DataFrame, gap_us: int, closing: str) -> DataFrame:
    """Give every event (user_id, us, event_id, event_type) its session number: a session ends by a gap of at
    least ``gap_us`` or with a closing event."""
    order = [F.col("us"), F.col("event_id")]
    before = framed(events, ["user_id"], order, 1, 0, {
        "_prev": lambda _, w: F.lag("us").over(w), "_kind": lambda _, w: F.lag("event_type").over(w)})
    fresh = F.col("_prev").isNull() | (F.col("us") - F.col("_prev") >= gap_us) | (F.col("_kind") == closing)
    return running(before.withColumn("_new", fresh.cast("int")).drop("_prev", "_kind"), ["user_id"], order, {"session": ("sum", F.col("_new"))}).drop("_new")


def close_sessions(numbered: DataFrame, gap_us: int, closing: str) -> DataFrame:
    last = F.max_by("event_type", F.struct("us", "event_id"))
    return numbered.groupBy("user_id", "session").agg(F.min("us").alias("start_us"), F.max("us").alias("_end"), F.count("*").alias("n"), last.alias("_last")).select(
        "user_id", "session", "start_us", (F.col("_end") + F.when(F.col("_last") == closing, 0).otherwise(gap_us)).alias("end_us"), "n")


def two_condition_sessions(events: DataFrame, gap_us: int, delay_us: int, closing: str) -> DataFrame:
    """Stream sessions that end by a gap or by a closing event, out-of-order rows merged, late rows dropped.

    Each micro-batch is joined with the events of the sessions still open (state and watermark are tables per
    batch number, so a repeated batch starts from the same point) and sessionised by the distributed window helpers; sessions
    that end before the watermark are final. After the stream ends, one more step uses its last watermark.
    """
    spark, root = events.sparkSession, scratch(events.sparkSession, "sessions")
    columns = ["user_id", "us", "event_id", "event_type"]
    empty = spark.createDataFrame([], "user_id long, us long, event_id long, event_type string")
    done = {"number": -1}

    def step(rows: DataFrame, number: int) -> None:
        top = spark.read.schema("top long").parquet(f"{root}/top/{number - 1}").first()["top"] if number else None
        mark = None if top is None else top - delay_us
        if mark is not None:
            rows = rows.filter(F.col("us") >= mark)
        held = spark.read.schema(empty.schema).parquet(f"{root}/open/{number - 1}") if number else empty
        numbered = cut(number_sessions(held.unionByName(rows), gap_us, closing), "numbered")
        sessions = close_sessions(numbered, gap_us, closing)
        final = F.col("end_us") < F.lit(mark) if mark is not None else F.lit(False)
        sessions.filter(final).write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        still = sessions.filter(~final).select("user_id", "session")
        numbered.join(still, ["user_id", "session"], "left_semi").select(*columns).write.mode("overwrite").parquet(f"{root}/open/{number}")
        numbered.agg(F.greatest(F.max("us"), F.lit(top).cast("long")).alias("top")).write.mode("overwrite").parquet(f"{root}/top/{number}")
        done["number"] = number

    rows = events.select("user_id", F.unix_micros("ts").alias("us"), "event_id", "event_type")
    rows.writeStream.foreachBatch(lambda b, i: step(b, i)).option("checkpointLocation", root + "-state").trigger(availableNow=True).start().awaitTermination()
    step(empty, done["number"] + 1)
    return spark.read.schema("user_id long, session long, start_us long, end_us long, n long").parquet(f"{root}/out/*").drop("session")
