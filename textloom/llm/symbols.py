"""Vectorised text kernels: bytes, words, rolling hashes, window anchors.

All of them work on the concatenation of several texts (a chunk), so that one
numpy call serves many rows; arithmetic is modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Symbols of a chunk, so that its arrays stay in a core's cache.
CHUNK = 1 << 17
#: Bits of an anchor candidate that hold its place; the others hold its hash, alike in every chunk.
INDEX_BITS = 31
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
LEVELS = _RNG.integers(1, 2**63, 64, dtype=U) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


#: What operators keep in a worker from task to task, by name: functions that drop it.
HELD: dict[str, Callable[[], None]] = {}


def trim(using: str = "") -> None:
    """Give freed memory back to the system: a Python worker lives on after its task.

    What is HELD goes too, but for what the caller is *using*: the next tasks may be of another operator.
    """
    for name, drop in HELD.items():
        if name != using:
            drop()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """BASE**j and BASE**-j, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4 * CHUNK)
            inverse = U(pow(int(BASE), -1, 1 << 64))
            steps = np.full(size, BASE)
            steps[0] = U(1)
            self.up = np.multiply.accumulate(steps)
            steps[1:] = inverse
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


POWERS = _Powers()


class Spans:
    """Hashes of any spans of one sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray) -> None:
        up, self.down = POWERS.get(len(symbols) + 1)
        self.prefix = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[: len(symbols)], out=self.prefix[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.prefix[stop] - self.prefix[start]) * self.down[start] + (stop - start).astype(U) * LEVELS[63])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about *size* bytes each; a longer text is a chunk of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, len(offsets) - 1)
        first = last


@dataclass
class Sequence:
    """Symbols of a run of texts; ``bounds[i]:bounds[i+1]`` are those of text i.

    For words, ``at`` and ``end`` are byte positions in the chunk's buffer.
    """

    symbols: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    at: np.ndarray | None = None
    end: np.ndarray | None = None


def as_bytes(data: np.ndarray, offsets: np.ndarray) -> Sequence:
    part = data[offsets[0] : offsets[-1]]
    return Sequence(BYTE_HASH[part], offsets - offsets[0], part)


def as_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Sequence:
    """Maximal runs of bytes other than white space, hashed; none crosses a text's end."""
    part = data[offsets[0] : offsets[-1]]
    if lower:
        part = _LOWER[part]
    bounds = offsets - offsets[0]
    n = len(part)
    if not n:
        empty = np.zeros(0, np.int64)
        return Sequence(np.zeros(0, U), np.zeros(len(bounds), np.int64), part, empty, empty)
    inside = ~_SPACE[part]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    at, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Sequence(Spans(BYTE_HASH[part]).hash(at, end), np.searchsorted(at, bounds), part, at, end)


def window_anchors(seq: Sequence, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k-gram of least hash (leftmost of equals) in every window of one text.

    (position, first window start, last window start, hash) of each anchor, in
    order. It depends on the window's content alone, so windows of equal
    content have their anchors at the same place. *k* is a power of two.
    """
    none = np.zeros(0, np.int64)
    n = len(seq.symbols)
    if n < window:
        return none, none, none, np.zeros(0, U)
    g, step, level = seq.symbols, 1, 0
    while step < k:
        g = g[:-step] * LEVELS[level] + g[step:]
        step, level = 2 * step, level + 1
    g = mix(g)
    bits = U(INDEX_BITS)
    v = (g >> bits << bits) | np.arange(len(g), dtype=U)
    width = window - k + 1
    span, m = 1, v
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    lengths = np.diff(seq.bounds)
    ok = np.zeros(n + 1, np.int32)
    full = lengths >= window
    np.add.at(ok, seq.bounds[:-1][full], 1)
    np.add.at(ok, seq.bounds[1:][full] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(ok[: len(m)]) > 0)
    if not len(start):
        return none, none, none, np.zeros(0, U)
    low = (m[start] & ((U(1) << bits) - U(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    last = np.concatenate((first[1:], [len(low)])) - 1
    return low[first], start[first], start[last], g[low[first]]


def ragged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the concatenated ranges start:stop, and the offsets of each."""
    lengths = stops - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1]), offsets


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of *data*."""
    data = np.ascontiguousarray(data)
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
