"""Vectorised word and shingle hashing over whole Arrow string columns.

Used inside Spark tasks.  Words are maximal runs of bytes that are not
``\\x20`` or ``\\x09``-``\\x0D`` after lower-casing ``A``-``Z``; UTF-8
continuation bytes are never separators, so working on bytes equals working on
code points.  All hashes are 64 bit and depend only on the bytes of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C13
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (in place on a fresh array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept per worker)."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes.

    Null texts are empty.  A single longer text makes a run of its own.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_binary()).fill_null(b"")
        n = len(chunk)
        if not n:
            continue
        _, off, data = chunk.buffers()
        off = np.frombuffer(off, dtype=np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            end = min(end, n)
            yield row + at, data[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end
        row += n


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row + total, word starts, word ends); words as they are unless ``lower``."""
    low = _LOWER[data] if lower else data
    inside = ~_BLANK[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    if len(edge):  # a word also ends where its row ends
        first[edge] |= inside[edge]
        last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(low) + 1)
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * up[: len(low)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, offsets), start, end


_STEP = [int(x) for x in (np.random.default_rng(7).integers(1, 1 << 62, 16, dtype=np.int64) * 2 + 1)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (the last n - 1 positions are left out)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _U(_STEP[k])
    return mix(out + _U(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes.

    Rows of fewer than ``n`` words, but not none, have one shingle: the whole
    sequence.  Rows without words have none.
    """
    h, at, _, _ = words(data, offsets)
    g = grams(h, n)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(grams(h[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit value, first byte) of each character of UTF-8 bytes; ``A``-``Z`` have the values of ``a``-``z``."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    values, lengths = _BYTE[_LOWER[data[starts]]], np.diff(starts, append=len(data))
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        values[longer] = values[longer] * _U(_STEP[k]) + _BYTE[data[starts[longer] + k]]
    return values, starts
