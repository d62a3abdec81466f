"""Sliding windows on streams from pane totals: the entering pane is added, the leaving one taken back.

A pane is one slide long. Every input batch is first reduced to one row per key and pane, so a hot key ships panes and not rows. The keyed state holds the panes of the current window and their total; when the watermark passes the end of a window, one pane enters and one leaves,
however many panes a window has. Measures are cut into integers (see ``operators.exact``), so what is taken back is exactly what was added.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from joulemill.operators.exact import joined, parts

LIMBS = 4  # integers of an exact sum
SHIFT = 30  # the first of them leaves a task in two halves, so that sums of a batch fit 64 bits


class Panes:
    """State of one key: panes by start, the total of those that have entered, and the end of the next window."""

    def __init__(self, width: int, slide: int, state: tuple | None):
        self.width, self.slide = width, slide
        starts, values, self.due = state or ([], [], None)
        step = len(values) // len(starts) if starts else 0
        self.panes = {at: [int(v) for v in values[i * step : (i + 1) * step]] for i, at in enumerate(starts)}
        self.total: list[int] = []
        for at in sorted(self.panes):
            if self.due is not None and at + slide < self.due:
                self.enter(at)

    def enter(self, at: int) -> None:
        new = self.panes.get(at)
        if new:
            self.total = [a + b for a, b in zip(self.total, new)] if self.total else list(new)

    def leave(self, at: int) -> None:
        old = self.panes.pop(at, None)
        if old:
            self.total = [a - b for a, b in zip(self.total, old)]

    def add(self, at: int, values: list[int]) -> None:
        self.panes[at] = [a + b for a, b in zip(self.panes[at], values)] if at in self.panes else values

    def windows(self, closed: int) -> Iterator[tuple[int, list[int]]]:
        """(start, total) of the windows with rows that end at ``closed`` or before and have not come out yet."""
        while self.panes:
            if not any(self.total):
                first = min(self.panes)  # nothing in the window: go on where rows are
                if self.due is None or self.due < first + self.slide:
                    self.due = first + self.slide
            if self.due > closed:
                return
            self.enter(self.due - self.slide)
            yield self.due - self.width, self.total
            self.leave(self.due - self.width)
            self.due += self.slide

    def state(self) -> tuple:
        starts = sorted(self.panes)
        return starts, [str(v) for at in starts for v in self.panes[at]], self.due


def folded(events: DataFrame, keys: list[str], measures: dict[str, Column], slide_ms: int) -> DataFrame:
    """(keys, _at, ts, _n, limbs): one row per key and pane of an input batch, with the time of its newest event, so that a hot key ships panes."""
    at = (F.floor(F.unix_millis("ts") / slide_ms) * slide_ms).alias("_at")
    columns, names = [], []
    for m, c in measures.items():
        top, *rest, out = parts(c)
        high = F.shiftright(top.cast("long"), SHIFT)
        limbs = [high, top.cast("long") - F.shiftleft(high, SHIFT), *[r.cast("long") for r in rest], out.isNotNull().cast("long")]
        for i, limb in enumerate(limbs):
            names.append(f"_{m}_{i}")
            columns.append(F.coalesce(limb, F.lit(0).cast("long")).alias(names[-1]))
    rows = events.select(*keys, at, "ts", F.lit(1).cast("long").alias("_n"), *columns)
    sums = {"ts": "max", "_n": "sum"} | dict.fromkeys(names, "sum")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.groupby([*keys, "_at"], dropna=False, sort=False, as_index=False).agg(sums)

    return rows.mapInPandas(fold, rows.schema)


def window_reduce(events: DataFrame, delay: str, keys: list[str], measures: dict[str, Column], width_ms: int, slide_ms: int) -> DataFrame:
    """(start, keys, n, one exact sum per measure) per sliding window that has rows, in append mode.

    ``events`` has ``ts`` and no watermark yet; it gets one of ``delay``. ``width_ms`` is a multiple of ``slide_ms``. Windows of a key come out when the
    watermark has passed their end, with or without new rows of the key; rows that are older than the watermark are dropped. Values beyond the
    exact range (infinities, NaN, 2**100 and more) raise an error: they cannot be taken back."""
    if width_ms % slide_ms or slide_ms <= 0:
        raise ValueError("a window is a whole number of slides")
    labels = list(measures)
    sent = [f"_{m}_{i}" for m in labels for i in range(6)]
    names = [f"_{m}_{i}" for m in labels for i in range(LIMBS)]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = Panes(width_ms, slide_ms, tuple(state.get) if state.exists else None)
        for frame in frames:
            for at, n, *limbs in frame[["_at", "_n", *sent]].itertuples(index=False):
                values = [int(n)]
                for i, m in enumerate(labels):
                    high, low, *rest, out = map(int, limbs[6 * i : 6 * i + 6])
                    if out:
                        raise ValueError(f"{m} has a value that cannot be taken back out of a window")
                    values += [(high << SHIFT) + low, *rest]
                held.add(int(at), values)
        mark = state.getCurrentWatermarkMs()
        found = [(at, *total) for at, total in held.windows(mark)]
        if held.panes:
            state.update(held.state())
            state.setTimeoutTimestamp(max(held.due, mark + 1))
        elif state.exists:
            state.remove()
        out = pd.DataFrame({"_start": [f[0] for f in found], "_n": [f[1] for f in found]}).astype("int64")
        for i, name in enumerate(names):
            out[name] = pd.Series([Decimal(f[2 + i]) for f in found], dtype=object)
        for k, v in zip(keys, key):
            out[k] = v
        yield out[["_start", *keys, "_n", *names]]

    types = dict(events.dtypes)
    result = ", ".join(["_start long", *[f"{k} {types[k]}" for k in keys], "_n long", *[f"{n} decimal(38,0)" for n in names]])
    panes = folded(events, keys, measures, slide_ms).withWatermark("ts", delay)
    windows = panes.groupBy(*keys).applyInPandasWithState(step, result, "starts array<long>, vals array<string>, due long", "append", "EventTimeTimeout")
    sums = [joined([*[F.col(f"_{m}_{i}") for i in range(LIMBS)], F.lit(None).cast("double")]).alias(m) for m in measures]
    return windows.select(F.timestamp_millis("_start").alias("start"), *keys, F.col("_n").alias("n"), *sums)
