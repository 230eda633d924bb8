"""Word hashes of many texts at once, with numpy on the UTF-8 bytes.

Words are runs of bytes other than space and ``\\t`` to ``\\r``. A piece of up to 8
bytes is its own code, told apart by its length in the last byte, and is only
mixed (a bijection), so no two of them share a hash; each different longer piece
is hashed with BLAKE2b. A run of k words is hashed as a tree: runs of 1, 2, 4, ...
words are joined in pairs with a mixing step each.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bits of a piece of 0 to 8 bytes, and what stands behind one of under 8: a last byte that ends no UTF-8 character.
_OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_TAG = np.array([*((0xF8 + n) << 56 for n in range(8)), 0], U)
#: Stands behind the numbers of longer pieces.
_LONG = U(0xF0 << 56)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, in order."""
    return mix((a * U(0x9E3779B97F4A7C15)) ^ b)


def _short(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of pieces of up to 8 bytes, and which pieces are longer."""
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    size = np.minimum(end - start, 9)
    codes = np.ndarray(len(data) + 1, "<u8", room, strides=1)[start]
    long = np.flatnonzero(size > 8)
    size[long] = 8
    return (codes & _OWN[size]) | _TAG[size], long


def _long(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]


def piece_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each piece, equal exactly where the bytes are; those of other calls mean nothing."""
    codes, long = _short(data, start, end)
    if len(long):
        seen: dict[bytes, int] = {}
        codes[long] = np.array([seen.setdefault(p, len(seen)) for p in _long(data, start[long], end[long])], U) | _LONG
    return codes


def piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, the same in every call."""
    codes, long = _short(data, start, end)
    out = mix(codes)
    if len(long):
        pieces = _long(data, start[long], end[long])
        digest = {p: hashlib.blake2b(p, digest_size=8).digest() for p in set(pieces)}
        out[long] = np.frombuffer(b"".join([digest[p] for p in pieces]), U)
    return out


class Words:
    """The words of a list of UTF-8 texts that lie one after another in ``data``.

    ``first[d]:first[d + 1]`` are the words of text d, ``start`` and ``end`` their
    places; ``hash`` has one entry for each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~SEPARATOR[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < n]
        begins[edges] = inside[edges]
        ends = inside
        ends = np.append(inside[:-1] & (~inside[1:] | begins[1:]), inside[-1:]) if n else inside
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return piece_hashes(self.data, self.start, self.end)

    def whole(self, k: int) -> np.ndarray:
        """Which runs of k words lie within one text; entry i is of the words i to i + k - 1 of the whole list."""
        m = max(0, len(self.start) - k + 1)
        out = np.ones(m, bool)
        for back in range(1, k):  # runs that would cross into the next text
            at = self.first[1:-1] - back
            out[at[(at >= 0) & (at < m)]] = False
        return out

    def grams(self, k: int, lane: int = 0) -> np.ndarray:
        """Hashes of all runs of k words; those of different lanes are independent."""
        m = max(0, len(self.start) - k + 1)
        power = mix(self.hash + U(lane) * U(0xA24BAED4963EE407)) if lane else self.hash
        out, done, size = None, 0, 1
        while m:
            if k & size:
                out = power[:m] if out is None else join(out, power[done : done + m])
                done += size
            if done == k:
                return out
            power = join(power[:-size], power[size:])
            size *= 2
        return np.zeros(0, U)


def slices(column: pa.Array, most: int = 1 << 20):
    """Cuts a string column into runs of rows with at most ``most`` bytes (one row at least).

    Yields (first row, row after the last, bytes as numpy, offsets from 0, null mask).
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    nulls = np.asarray(column.is_null())
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], nulls[lo:hi]
        lo = hi
