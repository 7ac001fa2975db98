"""Words of Arrow text batches as hash arrays, for tasks that work on whole batches.

Everything here runs inside a task on a bounded number of bytes at a time: ``blocks`` cuts a
batch into runs of rows of about ``BLOCK`` bytes, or one row if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = lambda b: np.multiply.accumulate(
        np.concatenate([np.ones(1, U64), np.full(n, b, U64)])
    )
    return ones(BASE), ones(BASE_INVERSE)


@lru_cache(maxsize=1)
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BLOCK)


def _span_hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of a run of rows: byte ranges in ``data``, hashes, and each row's word range."""

    data: np.ndarray
    rows: np.ndarray  # byte offsets of the rows, one more than rows
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of the first word of each row, one more than rows
    hashes: np.ndarray
    sums: np.ndarray
    down: np.ndarray

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _span_hashes(self.sums, self.down, starts, ends)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.first))


def blocks(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) of runs of rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, rows: np.ndarray, lower: bool = False) -> Words:
    """Words are runs of bytes other than the six ASCII space characters; A-Z may be lowered."""
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = ~IS_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[rows[:-1][rows[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[rows[1:][rows[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    # Only one row alone is longer than a block; its powers go with it.
    up, down = _block_powers() if n <= BLOCK else _powers(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE[data] * up[:n], out=sums[1:])
    hashes = _span_hashes(sums, down, starts, ends)
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows), hashes, sums, down)


def windows(hashes: np.ndarray, width: int, factor: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of every run of ``width`` values, whether or not it stays in one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(width):
        out *= U64(factor)
        out += hashes[j : n + j]
    return mix(out)


def in_row(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the runs of ``width`` words, by start, stay inside one row."""
    m = max(0, n - width + 1)
    left = np.repeat(first[1:], np.diff(first))[:m] - np.arange(m)
    return left >= width


def covered(marked: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words covered by the marked windows; ``marked`` is indexed by window start."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(marked)
    edge[at] += 1
    edge[at + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
