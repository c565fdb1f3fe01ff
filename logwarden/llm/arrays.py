"""Small numpy helpers for Arrow batches of texts: bytes in one buffer, words, window hashes.

Hashes are polynomials over 64-bit values modulo 2**64 with an odd base, so any window is two
look-ups in a running sum and one product with an inverse power; a final mix spreads the bits.
"""

import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Texts are taken in pieces of about this many bytes, which bounds the memory of a task.
PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


class Windows:
    """Hashes of any window of a sequence of 64-bit values."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Windows._powers) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("_powers", BASE), ("_inverse", INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(Windows, name, np.multiply.accumulate(powers))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * Windows._powers[:n], out=self.sums[1:])

    def hash(self, start, end) -> np.ndarray:
        """Hashes of the windows [start, end); both are arrays or slices of equal length."""
        return mix((self.sums[end] - self.sums[start]) * Windows._inverse[start])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def packed(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Binary column of the values between the row offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(rows) - 1, [
        None, pa.py_buffer((rows * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column in one array, and the offsets of its rows."""
    column = column.cast(pa.large_binary())
    rows = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    values = np.frombuffer(raw, np.uint8)[rows[0]:rows[-1]].view(kind) if raw else np.zeros(0, kind)
    return values, (rows - rows[0]) // np.dtype(kind).itemsize


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``column``, cut so that no value is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.asarray(batch.column(column))
        if held and values[0] != held[-1].column(column)[-1].as_py():
            yield pa.concat_batches(held)
            held = []
        cut = int(np.flatnonzero(values == values[-1])[0])
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column in one buffer and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; one longer row stays whole."""
    for batch in batches:
        _, offsets = plain(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one more at the end)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def tidy(function: Callable) -> Callable:
    """A function over batches that gives freed memory back at its end: workers outlive tasks, and
    those of one step stay beside those of the next."""
    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim is not None:
            trim(0)
    return run


def own_threads() -> None:
    """A task has one core: libraries with threads of their own use one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
