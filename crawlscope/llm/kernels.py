"""Array kernels over a column of texts: bytes, words, word hashes, shingles.

They run inside Arrow tasks. A batch is walked in pieces of about ``PIECE`` bytes, so memory does not
depend on the batch; a longer document is a piece of its own and is still processed whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1_000_000
STEP = 1 << 14
U64 = np.uint64

# The finaliser of the public splitmix64 generator.
_GOLDEN = U64(0x9E3779B97F4A7C15)
_MIX_1 = U64(0xBF58476D1CE4E5B9)
_MIX_2 = U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> U64(30))) * _MIX_1
        x = (x ^ (x >> U64(27))) * _MIX_2
        return x ^ (x >> U64(31))


_BASE = 0x5851F42D4C957F2D  # odd, and 5 modulo 8
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
ODD = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
# Letters and digits; every byte of a character outside ASCII counts as a letter.
NOT_ALNUM = ~byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
EXACT = mix(np.arange(256, dtype=U64))
FOLDED = EXACT.copy()  # A-Z count as a-z
FOLDED[0x41:0x5B] = EXACT[0x61:0x7B]

_powers = np.ones(1, U64), np.ones(1, U64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        # A piece of the usual size needs no more than this; only longer documents make the table double.
        n = max(n, PIECE + 1) if n <= PIECE + 1 else max(n, 2 * len(_powers[0]))
        made = []
        for base in (_BASE, _BASE_INVERSE):
            row = np.full(n, U64(base))
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers = tuple(made)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the bounds of each; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) for consecutive rows of about ``PIECE`` bytes of text."""
    for batch in batches:
        data, bounds = utf8(batch.column(batch.schema.get_field_index(text)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + PIECE, "right")) - 1)
            yield batch.slice(low, high - low), data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
            low = high


def steps(starts: np.ndarray, ends: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive byte ranges, in ascending order, that together span about ``most`` bytes."""
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + most, "right")))
        yield low, high
        low = high


def words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the word bounds of each text."""
    inside = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """64-bit hash of each byte range, by differences of one running polynomial sum."""
    with np.errstate(over="ignore"):
        power, inverse = _power(len(data) + 1)
        running = np.zeros(len(data) + 1, U64)
        for low in range(0, len(data), STEP):  # in steps that stay in the processor's cache
            part = running[low + 1 : low + STEP + 1]
            np.multiply(table[data[low : low + STEP]], power[low : low + len(part)], out=part)
            np.cumsum(part, out=part)
            part += running[low]
        raw = (running[ends] - running[starts]) * inverse[starts]
        return mix(raw ^ (ends - starts).astype(U64))


def shingles(hashed: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words and its bounds per text; fewer words make one run of all of them."""
    n, counts = len(hashed), np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(n)  # words from here to the end of the text
    first = np.zeros(n, bool)
    first[bounds[:-1][counts > 0]] = True
    with np.errstate(over="ignore"):
        total = np.minimum(left, k).astype(U64) * _GOLDEN
        for j in range(min(k, n)):
            total[: n - j] += np.where(left[: n - j] > j, hashed[j:] * ODD[j], U64(0))
    keep = (left >= k) | first & (left < k)
    return mix(total[keep]), np.concatenate([[0], np.cumsum(keep)])[bounds]


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    values = values[bounds[0] : bounds[-1]].copy()
    bounds = bounds - bounds[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, wrapping for integers."""
    running = np.zeros(len(values) + 1, values.dtype)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=running[1:])
        return running[bounds[1:]] - running[bounds[:-1]]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges (start, size), one range after the other."""
    total = int(sizes.sum())
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) + total < 1 << 31) else np.int64
    shift = (starts - np.cumsum(sizes) + sizes).astype(kind)
    out = np.repeat(shift, sizes)
    out += np.arange(total, dtype=kind)
    return out


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
