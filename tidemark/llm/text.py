"""Whole texts as NumPy arrays inside Arrow tasks, and the word definition shared by the operators.

A task works on at most ``BLOCK_BYTES`` of text and ``BLOCK_ROWS`` texts at a time beside the Arrow batch
itself, except for a single text that is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 1 << 10
WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES,
                rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, texts) of consecutive rows, limited in bytes and rows; null is the empty text."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        used = ends[first - 1] if first else 0
        end = min(first + rows, max(first + 1, int(np.searchsorted(ends, used + limit, "right"))), len(texts))
        yield first, end, texts.slice(first, end - first)
        first = end


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the offset of each text (one more than there are texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of marked bytes; a run never crosses into the next text."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run's bytes, from one prefix sum over the block."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; small tables are kept."""
    if _POWERS and len(_POWERS[0][0]) >= n:
        return _POWERS[0]
    size = max(n, BLOCK_BYTES)
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        made.append(np.cumprod(factors))
    made = tuple(made)
    if size <= 2 * BLOCK_BYTES:
        _POWERS[:] = [made]
    return made
