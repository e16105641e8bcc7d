"""Character n-grams of framed words as rows of a table, in numpy.

A word (A-Z in lower case) stands in a frame of one blank on each side; its n-grams are the windows of n bytes inside
the frame, so those that hold a blank are its prefixes and suffixes. Each n-gram and the whole word have a row among
``rows`` by their hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from bedtrace.llm.common import LOWER

CHUNK_WORDS = 100_000


@dataclass(frozen=True)
class Grams:
    orders: tuple[int, ...]
    rows: int  # a power of two; row ``rows`` of a table is for windows beyond the frame and stays 0

    def places(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the n-grams [order, place in the stream of framed words], and the first place of each word."""
        begin = np.cumsum(lens + 1) - (lens + 1)
        n = int(begin[-1] + lens[-1]) + 1
        stream = np.full(n + 8, 0x20, np.uint64)
        inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        stream[inner + np.repeat(begin + 1, lens)] = LOWER[data[inner + np.repeat(starts, lens)]]
        left = np.repeat(begin + lens + 1, lens + 1) - np.arange(n)  # places to the closing blank
        out = np.empty((len(self.orders), n), np.int32)
        bits = np.uint64(64 - int(self.rows).bit_length() + 1)
        for o, size in enumerate(self.orders):
            v = np.full(n, size, np.uint64)
            for k in range(size):
                v = v * np.uint64(256) + stream[k : k + n]
            row = ((v * np.uint64(0x9E3779B97F4A7C15)) >> bits).astype(np.int32)
            out[o] = np.where(left >= size - 1, row, self.rows)
        return out, begin

    def word_rows(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(self.rows - 1)).astype(np.int32)

    def counts(self, lens: np.ndarray) -> np.ndarray:
        """Number of n-grams of each word."""
        return sum(np.maximum(lens + 3 - size, 0) for size in self.orders)

    def sums(self, table: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over the n-grams of each word, in chunks of words."""
        out = np.empty((len(starts), table.shape[1]), np.float32)
        at = 0
        while at < len(starts):
            to = at + max(1, int(np.searchsorted(np.cumsum(lens[at : at + CHUNK_WORDS]), 1 << 20, "right")))
            rows, begin = self.places(data, starts[at:to], lens[at:to])
            total = table[rows[0]]
            for r in rows[1:]:
                total = total + table[r]
            out[at:to] = np.add.reduceat(total, begin, axis=0)
            at = to
        return out

    def distinct_sums(self, table: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``sums``, once for each distinct word: sums, one index of each distinct word, and the distinct word of each word."""
        _, pick, which = np.unique(hashes, return_index=True, return_inverse=True)
        return self.sums(table, data, starts[pick], lens[pick]), pick, which
