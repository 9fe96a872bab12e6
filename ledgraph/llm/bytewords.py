"""Vectorised word kernels over UTF-8 buffers.

Arrow hands a string column to Python as one byte buffer and its offsets.
Everything here works on these two arrays with numpy: words are found with a
byte table, and hashed with a polynomial whose prefix sums give each word's
hash in constant time.  No Python object is made per word.

A word set is any set of bytes that contains all bytes of multi-byte
characters or none, so byte runs are character runs.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SHARD_BYTES = 2 << 20
"""Text bytes that are worked on at once; a longer single text is its own shard."""

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32

# [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F], for text that is in lower case
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C17 | 3
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        def table(base: int) -> np.ndarray:
            t = np.full(n, base & _MASK, U64)
            t[0] = 1
            return np.cumprod(t, dtype=U64)
        _powers = table(_BASE), table(_INVERSE)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h = h * U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def shards(n_bytes: np.ndarray, limit: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay within the limit (one row at least)."""
    first, size = 0, 0
    for i, n in enumerate(n_bytes.tolist()):
        if size + n > limit and i > first:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(n_bytes):
        yield first, len(n_bytes)


def batches_of(batches: Iterator[pa.RecordBatch], text: str, limit: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text bytes; a task's end gives freed memory back, as workers live on."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) if not pa.types.is_null(column.type) else np.zeros(len(column), int)
        for lo, hi in shards(sizes, limit):
            yield batch.slice(lo, hi - lo)
    batch = column = sizes = None
    give_back()


def give_back() -> None:
    """Return memory that is free, but kept by the allocators, to the system."""
    global _powers
    if len(_powers[0]) > 2 * SHARD_BYTES:  # from a very long text
        _powers = (np.ones(1, U64), np.ones(1, U64))
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    """n_docs+1 offsets into the words."""


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross the offsets."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1]
    closes[:-1] &= ~member[1:]
    heads = offsets[:-1][offsets[:-1] < n]
    opens[heads] = member[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    closes[tails] = member[tails]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, U64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * power[:-1], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Words of all texts: maximal runs of member bytes after folding."""
    folded = fold[data]
    start, end = runs(member[folded], offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(start, end, doc, span_hash(folded, start, end), first)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words within a text, and the index of its first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    return window_hash(w.hash, k)[at], at


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of each k consecutive values."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), U64)
    factor = 1
    for j in range(k):
        factor = (factor * 0xA0761D6478BD642F + 0x2545F4914F6CDD1D) & _MASK | 1
        out += h[j : j + n] * U64(factor)
    return mix(out)


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated ranges first[i] .. first[i]+count[i]-1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(total)


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: entry i counts those that start before byte i."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def large(column: pa.Array) -> pa.Array:
    return column if not pa.types.is_null(column.type) else column.cast(pa.string())
