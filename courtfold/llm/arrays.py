"""Numpy helpers over Arrow string columns: words, hashes and windows of many texts at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SECOND = np.uint64(0xD6E8FEB86659FD93)
SECOND_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: Rows of a batch that are copied at a time.
ROWS = 512
_powers: dict[int, np.ndarray] = {}


def tidied(run: Callable) -> Callable:
    """A function over a task's batches that gives freed memory back to the system at its end: Spark keeps the worker for other stages."""

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return inner


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, since batches ask for similar lengths."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Random numbers for each of two hash functions, place modulo PLACES and byte.
PLACES = 64
TABLES = np.random.default_rng(0x5EED).integers(0, 1 << 64, (2, PLACES * 256), np.uint64)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, step: int = 1 << 17) -> np.ndarray:
    """64-bit hash of the bytes of each range; ranges don't overlap and come in order. `which` chooses one of two independent functions.

    Each place and byte stands for a random number, and a hash is the sum of its range's, so two certain contents collide with a chance of 2**-64, whatever their
    pattern. Bytes are taken a stretch at a time, so a long range costs no more memory than short ones.
    """
    sums = np.zeros(len(starts), np.uint64)
    for k in range(0, len(data), step):
        a, b = int(np.searchsorted(ends, k, "right")), int(np.searchsorted(starts, k + step))
        if a >= b:
            continue
        low, n = np.maximum(starts[a:b], k), np.minimum(ends[a:b], k + step)
        n = np.maximum(n - low, 0)
        upto = np.cumsum(n)
        inside = np.arange(upto[-1]) - np.repeat(upto - n, n)  # place in the part of the range that the stretch holds
        bytes_ = data[inside + np.repeat(low, n)]
        place = inside + np.repeat(low - starts[a:b], n)
        h = TABLES[which][(place % PLACES) * 256 + bytes_]
        far = np.flatnonzero(place >= PLACES)
        h[far] = mix(h[far] + (place[far] // PLACES).astype(np.uint64) * BASE)
        some = np.flatnonzero(n)
        if len(some):
            sums[a + some] += np.add.reduceat(h, (upto - n)[some])
    return mix(sums + (ends - starts).astype(np.uint64) * SECOND)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base=BASE, inverse=BASE_INVERSE) -> np.ndarray:
    """Mixed 64-bit polynomial hash of values[starts[i]:ends[i]] for every i. The values must be hashes themselves, or the ranges short: long patterns of two values collide for any base."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(inverse, len(values) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * SECOND)


def near_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base=BASE, inverse=BASE_INVERSE, step: int = 1 << 20) -> np.ndarray:
    """range_hashes() of short ranges in order of their starts, a stretch of the values at a time."""
    out = np.zeros(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(values) + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if a < b:
            shift = k * step
            out[a:b] = range_hashes(values[shift : int(ends[a:b].max())], starts[a:b] - shift, ends[a:b] - shift, base, inverse)
    return out


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about `most` text bytes; yields (rows, bytes, offsets). Null texts are empty."""
    i = batch.schema.get_field_index(column)
    for k in range(0, batch.num_rows, ROWS):
        own = batch.slice(k, ROWS)
        texts = pc.fill_null(own.column(i).cast(pa.large_string()), "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            yield own.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def words_of(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in the bytes, or of runs of other than the given bytes, and the first word of each row (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~white[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    stops[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def windows_of(first: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of `width` items fits into the row that first[] (row bounds) puts it in."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64)
    skipped = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(counts.sum()) + skipped


def covered(positions: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of `width` that starts at one of the positions."""
    edges = np.bincount(positions, minlength=n + 1) - np.bincount(np.minimum(positions + width, n), minlength=n + 1)
    return np.cumsum(edges[:n]) > 0
