"""Hashes of the words of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SLICE = 1 << 20  # bytes worked on at once; a longer text is a slice of its own


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words; keeps the tables of powers between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE)
            one = np.ones(1, dtype=np.uint64)
            self.up = np.multiply.accumulate(np.concatenate([one, np.full(n, BASE)]))
            self.down = np.multiply.accumulate(np.concatenate([one, np.full(n, INVERSE)]))

    def hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hash of every word of the texts that begin at ``starts`` in ``data`` (A-Z folded to a-z), and the texts' word counts.
        A word's hash is the difference of a running sum of byte * base^place, moved back to place 0."""
        n = len(data)
        self.powers(n + 1)
        blank = BLANK[data]
        before = np.empty(n, dtype=bool)
        before[:1], before[1:] = True, blank[:-1]
        before[starts[starts < n]] = True
        first = np.flatnonzero(~blank & before)
        after = np.empty(n, dtype=bool)
        after[-1:], after[:-1] = True, blank[1:]
        after[(starts[(starts > 0) & (starts <= n)]) - 1] = True
        last = np.flatnonzero(~blank & after) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        counts = np.diff(np.append(np.searchsorted(first, starts), len(first)))
        return mixed((total[last] - total[first]) * self.down[first]), counts


def slices(texts: pa.StringArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts of the rows in them) for runs of rows of at most ``SLICE`` bytes, or one longer row. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, side="right")) - 1)
        end = min(end, len(texts))
        yield row, end, raw[at[row] : at[end]], at[row:end] - at[row]
        row = end
