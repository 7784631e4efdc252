"""Vectorised word and phrase hashing over Arrow text buffers.

Tasks work on the UTF-8 bytes that Arrow hands them: a word is a maximal run of bytes outside a separator set,
its hash is a polynomial over per-byte random values taken from one running sum, and a phrase of k words takes the
same step over word hashes. The cost per byte does not depend on k. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a slice of an Arrow batch that is handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_BLOCK = 1 << 20
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of plain words: ASCII white space.
WHITE_SPACE = _WHITE
#: Separators of bare words: every ASCII byte but letters, digits and the apostrophe.
NOT_WORD = np.array([i < 128 and not (chr(i).isalnum() or chr(i) == "'") for i in range(256)])

#: A random value for each byte, and the same with ASCII upper case mapped to lower case.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240131)).integers(1, 2**64, 256, np.uint64, endpoint=False)
LOWER_VALUES = BYTE_VALUES[[i + 32 if 65 <= i <= 90 else i for i in range(256)]]

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), or those of its inverse, kept and grown by doubling."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024, 0 if have is None else 2 * len(have)), pow(base, -1, 2**64) if inverse else base, np.uint64)
        steps[0] = 1
        have = _powers[(base, inverse)] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)


def give_back() -> None:
    """Return freed memory to the system: a Python worker that waits for its next task holds on to it otherwise, beside the workers of other stages."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str = "text", size: int = SLICE_BYTES, rows: int = 4000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into (batch, bytes, offsets from 0) of at most size bytes and rows rows, one row at least."""
    for batch in batches:
        offsets, data = text_buffers(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1), i + rows, n)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
    give_back()


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row number of every word; no word spans two rows."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """One hash per word, equal for equal words wherever they stand. Works in blocks of whole words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        block = values[data[base : ends[j - 1]]]
        block *= powers(_BYTE_BASE, len(block))
        np.cumsum(block, out=block)
        at = starts[i:j] - base
        h = block[ends[i:j] - base - 1]
        h[at > 0] -= block[at[at > 0] - 1]
        h *= powers(_BYTE_BASE, int(at[-1]) + 1, True)[at]
        out[i:j] = mix(h)
        i = j
    return out


def phrase_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether those lie in one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    sums = np.cumsum(words * powers(_WORD_BASE, len(words)))
    h = sums[k - 1 :].copy()
    h[1:] -= sums[: n - 1]
    h *= powers(_WORD_BASE, n, True)
    return mix(h), rows[:n] == rows[k - 1 :]
