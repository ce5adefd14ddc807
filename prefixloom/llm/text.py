"""Vectorised byte-level text kernels that work on Arrow string buffers without making Python strings.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes; ASCII letters are lower-cased.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _LOWER.astype(U) + U(1)
_COEF = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1 for i in range(64)], dtype=U)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        size = 1 << max(20, int(n).bit_length())
        for key, r in (("p", _R), ("i", _R_INV)):
            p = np.full(size, r, dtype=U)
            p[0] = 1
            _tables[key] = np.multiply.accumulate(p)
    return _tables["p"], _tables["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; returns a new array."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


@dataclass
class Words:
    """Words of consecutive rows [row0, row1): byte bounds relative to `data`, hash, and each row's first word."""

    row0: int
    row1: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.row1 - self.row0), np.diff(self.first))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def words(column: pa.Array, limit: int = 1 << 20) -> Iterator[Words]:
    raw, offsets = buffers(column)
    for a, b in spans(offsets, limit):
        off = offsets[a : b + 1] - offsets[a]
        yield _split(a, b, raw[offsets[a] : offsets[b]], off)


def _split(a: int, b: int, data: np.ndarray, off: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return Words(a, b, data, e, e, np.zeros(0, U), np.zeros(b - a + 1, np.int64), off)
    inside = _WORD[data]
    edge = np.empty(n, bool)
    edge[1:] = ~inside[:-1]
    edge[0] = True
    heads = off[:-1]
    edge[heads[heads < n]] = True
    start = np.flatnonzero(inside & edge)
    edge[:-1] = ~inside[1:]
    edge[-1] = True
    tails = off[1:]
    edge[tails[tails > 0] - 1] = True
    end = np.flatnonzero(inside & edge) + 1
    power, inverse = _powers(n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start])
    return Words(a, b, data, start, end, h, np.searchsorted(start, off), off)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the index of each one's first word; shingles don't cross rows."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(n, U)
    for j in range(k):
        h += w.hash[j : j + n] * _COEF[j]
    ok = np.ones(n, bool)
    bounds = w.first[1:-1]
    for j in range(1, k):
        x = bounds - j
        ok[x[(x >= 0) & (x < n)]] = False
    at = np.flatnonzero(ok)
    return mix(h[at]), at


def row_hash(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two order-dependent 64-bit hashes of each row's word sequence."""
    n = len(w.hash)
    rows = w.row1 - w.row0
    at = np.arange(n) - w.first[:-1][w.row] if n else np.zeros(0, np.int64)
    power, _ = _powers(int(at.max(initial=0)) + 1)
    out = []
    for salt in (U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)):
        h = mix(w.hash ^ salt) * power[at] if n else np.zeros(0, U)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(h)]) if n else np.zeros(1, U)
        out.append(mix(sums[w.first[1:]] - sums[w.first[:-1]] + np.diff(w.first).astype(U)) if rows else np.zeros(0, U))
    return out[0], out[1]


def run_hash(hashes: np.ndarray) -> np.ndarray:
    """The hash that shingles() gives a run of exactly these words."""
    return mix(np.array([(hashes * _COEF[: len(hashes)]).sum(dtype=U)], dtype=U))
