"""Word spans and rolling hashes over Arrow string columns, a few megabytes of text at a time.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Hashes are polynomials modulo 2^64,
finished by a mixing step, computed for all words (or all windows of words) of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # numpy temporaries of a chunk are many times its bytes
_BLOCK = 1 << 20
_BASE, _BASE_INVERSE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))

BREAK = np.zeros(256, dtype=bool)
BREAK[[9, 10, 11, 12, 13, 32]] = True


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices with at most ``limit`` bytes of text each (one row at least); null becomes empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.large_binary()), b"")
        batch = batch.set_column(at, column, text)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a large_binary column without nulls; offsets start at 0."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a chunk of rows: ``start``/``end`` into ``data``; row r has the words ``first[r]`` to ``first[r + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(column: pa.Array) -> Words:
    """Words of every row; no word reaches over the end of a row."""
    data, offsets = raw(column)
    inside = ~BREAK[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    low, high = offsets[:-1][full], offsets[1:][full] - 1
    starts[low], ends[high] = inside[low], inside[high]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(12, int(n).bit_length()))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]`` for many ordered spans that don't overlap; equal bytes, equal hash."""
    out = np.empty(len(start), dtype=np.uint64)
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(end, start[low] + _BLOCK, side="right")))
        at = start[low]
        block = data[at : end[high - 1]]
        up, down = _powers_for(len(block) + 1)
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
        s, e = start[low:high] - at, end[low:high] - at
        out[low:high] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        low = high
    return mix(out)


def span_hashes_of(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Like ``span_hashes`` for spans of 64-bit values, all in one block."""
    up, down = _powers_for(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.start, words.end)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values (``len(values) - width + 1`` of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for low in range(0, n, _BLOCK):
        high = min(n, low + _BLOCK)
        block = values[low : high + width - 1]
        up, down = _powers_for(len(block) + 1)
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(block * up[: len(block)], out=sums[1:])
        out[low:high] = (sums[width:] - sums[:-width]) * down[: high - low]
    return mix(out)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of the hash polynomial, for ``window_hashes_at``."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers_for(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def window_hashes_at(sums: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The ``window_hashes`` of some starts only, from the values' ``prefix_sums``."""
    return mix((sums[start + width] - sums[start]) * _powers_for(len(sums))[1][start])


def window_starts(words: Words, width: int) -> np.ndarray:
    """Word positions at which a window of ``width`` words of one row starts."""
    at = np.arange(len(words.start) - width + 1 if len(words.start) >= width else 0)
    return at[at + width <= np.repeat(words.first[1:], words.counts)[: len(at)]]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask over ``n`` positions of those in a window of ``width`` that begins at one of ``starts``."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes: small ones leave planes of zeros, which shuffle compression removes."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: memoryview, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(kind)[:n]
