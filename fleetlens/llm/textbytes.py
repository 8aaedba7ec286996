"""Vectorised work on the UTF-8 bytes of an Arrow text column.

Words are runs of bytes outside space and 0x09 to 0x0D.  They are hashed with a
polynomial over the bytes (mod 2**64, then mixed), from prefix sums, so a batch needs
no Python loop over words.  Texts are worked on in pieces of about ``PIECE`` bytes
cut at white space, so memory does not grow with the length of a text beyond the
results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C55  # odd, so that powers can be undone


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.string()), False
    buffers, n = column.buffers(), len(column)
    if not n or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)
    offsets = offsets.astype(np.int64)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:  # bytes behind nulls
            data = np.concatenate([data[a : a + k] for a, k in zip(offsets[:-1], lengths, strict=True)] or [data[:0]])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``limit`` bytes together, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, mod 2**64."""
    def series(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return series(BASE), series(pow(BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Word hashes of the rows of a text column."""

    def __init__(self, lower: bool, space: np.ndarray | None = None):
        self.space = space_table() if space is None else space
        self.lower = lower_table() if lower else None
        self.power, self.inverse = powers(2 * PIECE)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            self.power, self.inverse = powers(n + PIECE)

    def spans(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every word; ``edges`` are row borders inside ``data``."""
        blank = self.space[data]
        first, final = ~blank, ~blank
        first[1:] &= blank[:-1]
        final[:-1] &= blank[1:]
        inner = edges[(edges > 0) & (edges < len(data))]
        first[inner] = ~blank[inner]
        final[inner - 1] = ~blank[inner - 1]
        return np.flatnonzero(first), np.flatnonzero(final) + 1

    def hash_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        values = (self.lower[data] if self.lower is not None else data).astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * self.power[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.inverse[starts]
        return mixed(h + (ends - starts).astype(np.uint64))

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first byte, end, row borders) of pieces that end at a row or a blank."""
        for i, j in row_groups(offsets):
            a, b = int(offsets[i]), int(offsets[j])
            if b - a <= 2 * PIECE or j > i + 1:
                yield a, b, offsets[i : j + 1] - a
                continue
            while a < b:  # one long row
                end = min(a + PIECE, b)
                while end < b:
                    gap = np.flatnonzero(self.space[data[end : end + PIECE]])
                    if len(gap):
                        end += int(gap[0])
                        break
                    end = min(end + PIECE, b)
                yield a, end, np.array([0, end - a])
                a = end

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first bytes and ends of all words, and the n + 1 word offsets of the rows."""
        hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, edges in self.pieces(data, offsets):
            if a == b:
                continue
            first, final = self.spans(data[a:b], edges)
            hashes.append(self.hash_spans(data[a:b], first, final))
            starts.append(first + a)
            ends.append(final + a)
        at = np.concatenate(starts)
        return np.concatenate(hashes), at, np.concatenate(ends), np.searchsorted(at, offsets)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, one for each first word that has enough after it."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mixed(out)
