"""Numpy helpers over Arrow string batches, used inside tasks.

A batch's text column is read as one byte buffer plus document offsets, so
per-byte work (word bounds, hashes, class counts) is vectorised over many
documents at once and no Python string is made per row.  Documents are taken
in chunks of a few megabytes, which bounds the working memory of a task by
the chunk (or by the longest single document), never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; a null is an empty slice."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        # a null's slot may span bytes: pack the valid slices
        valid = np.asarray(column.is_valid())
        if (np.diff(off)[~valid] != 0).any():
            parts = [raw[off[i]:off[i + 1]] for i in range(n) if valid[i]]
            size = np.where(valid, np.diff(off), 0)
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), bounds(size)
    return raw[off[0]:off[-1]], off - off[0]


def bounds(sizes: np.ndarray) -> np.ndarray:
    """Offsets ``[0, s0, s0+s1, ...]`` of consecutive slices of the given sizes."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def chunks(buf: np.ndarray, off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first_row, end_row, bytes, offsets)`` over runs of rows of about ``most`` bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def total(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set positions in each slice ``[at[i], at[i+1])``."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return np.diff(c[at])


def total_of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each slice ``[at[i], at[i+1])``."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return np.diff(c[at])


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes; runs end at document bounds."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (in place)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * CHUNK_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        _pow, _inv = (np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]) for b in (_BASE, inverse))
        np.cumprod(_pow, out=_pow)
        np.cumprod(_inv, out=_inv)
    return _pow[:n], _inv[:n]


def forget() -> None:
    """Drop the table of powers if a very long text has made it grow."""
    global _pow, _inv
    if len(_pow) > 4 * CHUNK_BYTES:
        _pow, _inv = np.ones(1, U64), np.ones(1, U64)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash; see :func:`slice_hash`."""
    p, _ = _powers(max(1, len(buf)))
    s = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * p[:len(buf)], out=s[1:])
    return s


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each slice; equal for equal bytes wherever they stand."""
    _, inv = _powers(max(1, len(prefix)))
    h = (prefix[end] - prefix[start]) * inv[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive item hashes (``len(h) - k + 1`` of them)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    g = np.zeros(m, U64)
    for j in range(k):
        g *= U64(0x9FB21C651E98DF25)
        g += h[j:j + m]
    return mix(g)


def fold(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each slice of item hashes as a sequence."""
    place = np.arange(len(h), dtype=U64) - np.repeat(at[:-1], np.diff(at)).astype(U64)
    s = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h + place * U64(0x9E3779B97F4A7C15)), out=s[1:])
    return mix(s[at[1:]] - s[at[:-1]] + np.diff(at).astype(U64))


def distinct(sorted_values: np.ndarray) -> np.ndarray:
    """First of each run of equal values of a sorted array, as a mask."""
    first = np.ones(len(sorted_values), bool)
    first[1:] = sorted_values[1:] != sorted_values[:-1]
    return first


def uniq(values: np.ndarray) -> np.ndarray:
    s = np.sort(values)
    return s[distinct(s)]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices ``start[i] .. start[i]+size[i]-1`` for all i, one after another."""
    at = bounds(size)
    return np.arange(at[-1], dtype=np.int64) + np.repeat(start - at[:-1], size)


def table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


#: Bytes between words of ``[^\x20\x09-\x0D]+``.
BLANK = table(b" \t\n\x0b\x0c\r")
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, at)`` of blank-separated words; document i has words ``at[i] .. at[i+1]``."""
    start, end = spans(~BLANK[buf], off)
    return start, end, np.searchsorted(start, off)
