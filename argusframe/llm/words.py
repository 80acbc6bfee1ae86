"""Words of whole texts as hash arrays, computed over Arrow buffers in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

PIECE_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MIX = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=U64) | U64(1)
_MIX_LOWER = _MIX.copy()
_MIX_LOWER[65:91] = _MIX[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next piece."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if len(have) <= 4 * PIECE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


@dataclass
class Piece:
    """Consecutive rows of a batch: their bytes, and the words in them.

    row0, rows: which rows of the batch; offsets: byte bounds of each row; start, end: byte
    bounds of each word; row: the row (from 0 within the piece) of each word; hash: its value.
    """

    row0: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many marked bytes each row has."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows).astype(np.int64)

    def chars_before(self) -> np.ndarray:
        """Code points from the start of the piece to each byte, one entry more than bytes."""
        return np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit value of each byte range, equal for equal ranges."""
    if not len(start):
        return np.zeros(0, U64)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_MIX_LOWER if lower else _MIX)[data] * _power(_BASE, len(data)), out=sums[1:])
    value = (sums[end] - sums[start]) * _power(_BASE_INVERSE, len(data) + 1)[start]
    return mix(value + (end - start).astype(U64))


def pieces(texts: pa.Array, lower: bool = True) -> Iterator[Piece]:
    """Cut a text column into pieces of about PIECE_BYTES; one longer text is a piece by itself."""
    column = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    _, at, body = column.buffers()
    bounds = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row0 = 0
    while row0 < n:
        last = int(np.searchsorted(bounds, bounds[row0] + PIECE_BYTES, "right")) - 1
        last = min(max(last, row0 + 1), n)
        offsets = bounds[row0 : last + 1] - bounds[row0]
        yield piece(whole[bounds[row0] : bounds[last]], offsets, row0, lower)
        row0 = last


def piece(data: np.ndarray, offsets: np.ndarray, row0: int, lower: bool) -> Piece:
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid
    if len(data):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Piece(
        row0, len(offsets) - 1, data, offsets, start, end, row, span_hash(data, start, end, lower)
    )


def windows(values: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one row, and the index of its first word."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for j in range(k):
        total = total * U64(0xD1342543DE82EF95) + values[j : j + n]
    inside = row[:n] == row[k - 1 :]
    return mix(total[inside]), np.flatnonzero(inside)


def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct `whole`, with the new `text`, and n_chars of it if there is one."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in columns))
