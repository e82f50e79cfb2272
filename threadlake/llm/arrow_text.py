"""Arrow batches of texts as flat byte arrays, and vectorised hashes over them.

Every helper works on slices of bounded size, so that memory follows the slice
(or the longest single text), never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; numpy needs about 60 times as much for a moment.
SLICE_BYTES = 1 << 18

#: Powers that a waiting worker keeps, 16 bytes each.
MOST_POWERS = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    """256 fixed 64-bit words, one per byte value."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                factors = np.full(m, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up, self.down


POWERS = Powers()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for ``mapInArrow``, which at its end gives the worker's unused memory back.

    Workers live on from stage to stage and wait there with what they hold.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def release() -> None:
    """Drops tables that can be built again, and hands unused memory to the system."""
    if len(POWERS.up) > MOST_POWERS:
        POWERS.__init__()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base**i before each position (n + 1 words, modulo 2**64)."""
    up, _ = POWERS.grow(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], independent of where the span lies."""
    _, down = POWERS.grow(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text is empty.

    A slice holds at most ``limit`` bytes, or one longer text.
    """
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32 if pa.types.is_string(column.type) else np.int64, n + 1, offset=column.offset * (4 if pa.types.is_string(column.type) else 8)).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def code_points(data: np.ndarray) -> np.ndarray:
    """Positions of the bytes that begin a code point."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words [^\\x20\\x09-\\x0D]+ of texts laid end to end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.ones(len(data) + 1, np.bool_)
    inside[:-1] = (data != 32) & ((data < 9) | (data > 13))
    inside[-1] = False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] |= inside[firsts]
    begins[-1] = False
    start = np.flatnonzero(begins)
    stop = np.ones(len(data) + 1, np.bool_)
    stop[:-1] = ~inside[:-1]
    stop[firsts] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, start, "right")]
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row
