"""Vectorised work on the bytes of many texts at once (NumPy, inside tasks).

Texts come as one uint8 buffer with offsets, the layout of an Arrow string column,
so a batch of documents costs a few array passes instead of a Python loop a word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

#: Bytes of text that one array pass takes; a longer document makes a pass of its own.
PASS_BYTES = 2 << 20


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) > n:
        return
    size = max(n + 1, PASS_BYTES + 1)

    def series(base: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            step = np.full(size, np.uint64(base % (1 << 64)))
            step[0] = 1
            return np.multiply.accumulate(step)

    _powers, _inverse = series(_MULT), series(pow(_MULT, -1, 1 << 64))


@functools.cache
def _libc():
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim.argtypes = [ctypes.c_size_t]
        return libc
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Gives free memory back: workers live on between tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty texts."""
    release()
    values = batch.column(batch.schema.get_field_index(name))
    if values.null_count:
        values = values.fill_null("")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    if not wide and not (pa.types.is_string(values.type) or pa.types.is_binary(values.type)):
        values, wide = values.cast(pa.large_string()), True
    _, offsets, data = values.buffers()
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def passes(offs: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes, or one document."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment's bytes; depends on nothing but these bytes."""
    _grow(len(buf))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers[: len(buf)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, a-z and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
    A-Z, and for each document the first word's index (n + 1 bounds)."""
    low = _LOWER[buf]
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _WORD[low]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return segment_hashes(low, starts, ends), np.searchsorted(starts, offs)
