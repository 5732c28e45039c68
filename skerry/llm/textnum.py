"""Whole-column text work in numpy, straight on Arrow's UTF-8 buffers.

A word's hash adds up its blocks of eight bytes, each mixed with its place, so a
column of texts is split and hashed without a Python object per word.  Two words
share a hash with probability 2**-64 each pair, whatever their letters' order.
Blocks of about ``BLOCK`` bytes bound the memory whatever the batch; a longer
text is cut at a separator.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
#: Blocks of eight bytes up to which a span's hash is added block by block for all spans at once.
_DIRECT = 8
#: By number of bytes: the bits of a block that are kept.
_KEPT = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Space and the ASCII controls 9 to 13.
SPACES = (9, 10, 11, 12, 13, 32)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


@lru_cache(maxsize=1)
def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def lowered(d: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _lower_table()[d]


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


@lru_cache(maxsize=8)
def separator_table(separators: tuple[int, ...]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(separators)] = True
    return t


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null rows have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of a block of rows: row (within the block), start, end (byte positions), hash."""

    __slots__ = ("row", "start", "end", "hash")

    def __init__(self, row, start, end, hash_):
        self.row, self.start, self.end, self.hash = row, start, end, hash_


def hash_spans(d: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the byte spans start:end of d; ``lower`` takes A-Z as a-z.

    Each block of eight bytes is mixed with its place in the span before the blocks
    are added, so no structure of the bytes cancels out.
    """
    n, size = len(start), end - start
    if lower:
        d = lowered(d)
    padded = np.concatenate([d, np.zeros(8, np.uint8)])
    loads = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = mix(size.astype(np.uint64) + _U(_R))
    short = np.flatnonzero(size <= 8 * _DIRECT)
    for j in range(_DIRECT):
        short = short[size[short] > 8 * j]
        if not len(short):
            break
        out[short] += _mixed(loads, start[short] + 8 * j, size[short] - 8 * j, np.array([j], dtype=np.uint64))
    long_ = np.flatnonzero(size > 8 * _DIRECT)
    if len(long_):
        n = -(-size[long_] // 8)
        place = ragged(np.zeros(len(n), np.int64), n)
        for lo, hi in blocks(np.concatenate([[0], np.cumsum(n)])):
            own = slice(int(n[:lo].sum()), int(n[:hi].sum()))
            at, left = place[own], np.repeat(size[long_[lo:hi]], n[lo:hi])
            parts = _mixed(loads, np.repeat(start[long_[lo:hi]], n[lo:hi]) + 8 * at, left - 8 * at, at.astype(np.uint64))
            out[long_[lo:hi]] += np.add.reduceat(parts, np.cumsum(n[lo:hi]) - n[lo:hi])
    return mix(out)


def _mixed(loads: np.ndarray, at: np.ndarray, left: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, those past ``left`` zero, mixed with their place."""
    x = loads[at].view(np.uint64).reshape(-1)
    x = x & _KEPT[np.minimum(left, 8)]
    return mix((x ^ mix(place * _U(_R) + _U(1))) * _U(_R))


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse) of the distinct spans: equal hashes are compared byte by byte, so a clash costs nothing but a span more."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    size = end - start
    rep = first[inverse]
    other = np.flatnonzero(rep != np.arange(len(rep)))
    bad = size[other] != size[rep[other]]
    same = other[~bad]
    for lo, hi in blocks(np.concatenate([[0], np.cumsum(size[same])])):
        own = same[lo:hi]
        differs = data[ragged(start[own], size[own])] != data[ragged(start[rep[own]], size[own])]
        if differs.any():
            bad[np.searchsorted(other, np.unique(np.repeat(own, size[own])[differs]))] = True
    if bad.any():
        clash = other[bad]
        inverse[clash] = len(first) + np.arange(len(clash))
        first = np.concatenate([first, clash])
    return first, inverse


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(sizes) - sizes)
    return np.repeat(shift, sizes) + np.arange(total)


def _split(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lower: bool) -> Words:
    lo, hi = int(offsets[0]), int(offsets[-1])
    d = data[lo:hi]
    n = len(d)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64))
    rel = offsets - lo
    inside = ~sep[d]
    first = np.zeros(n + 1, dtype=bool)
    first[rel] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    start = np.flatnonzero(inside & (before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    end = np.flatnonzero(inside & (after | first[1:])) + 1
    h = hash_spans(d, start, end, lower)
    row = np.searchsorted(rel, start, side="right") - 1
    return Words(row, start + lo, end + lo, h)


def words(data: np.ndarray, offsets: np.ndarray, separators: tuple[int, ...] = SPACES, lower: bool = True) -> Words:
    """Words of the rows that ``offsets`` bound; equal words have equal hashes wherever they stand."""
    sep = separator_table(tuple(separators))
    if len(offsets) > 2 or offsets[-1] - offsets[0] <= 2 * BLOCK:
        return _split(data, offsets, sep, lower)
    parts = [_split(data, np.array(p), sep, lower) for p in row_parts(data, int(offsets[0]), int(offsets[-1]), separators)]
    return Words(*(np.concatenate([getattr(p, k) for p in parts]) for k in Words.__slots__))


def row_parts(data: np.ndarray, lo: int, hi: int, separators: tuple[int, ...] = SPACES) -> Iterator[tuple[int, int]]:
    """Parts of one long row of about a block each, cut where a separator stands; a longer word stays whole."""
    sep = separator_table(tuple(separators))
    while lo < hi:
        cut = min(lo + BLOCK, hi)
        while cut < hi and not sep[data[cut]]:
            ahead = np.flatnonzero(sep[data[cut : cut + BLOCK]])
            cut = cut + int(ahead[0]) if len(ahead) else min(cut + BLOCK, hi)
        yield lo, cut
        lo = cut


def row_starts(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Bounds of each row's words in word order (n_rows + 1 values)."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def shingles(w: Words, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): each row's distinct k-word shingles, sorted; a row of fewer words has its whole sequence as one."""
    bounds = row_starts(w.row, n_rows)
    c = constants(k, 23)
    n = len(w.hash)
    if n >= k:
        h = w.hash[: n - k + 1] * c[0]
        for j in range(1, k):
            h = h + w.hash[j : n - k + 1 + j] * c[j]
        h = mix(h)
    else:
        h = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(n_rows + 1, dtype=np.int64)
    for r in range(n_rows):
        a, b = int(bounds[r]), int(bounds[r + 1])
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for j in range(a, b):
                    x = x * _U(_R) + w.hash[j]
            s = mix(np.array([x], dtype=np.uint64))
        else:
            continue
        out.append(s)
        sizes[r + 1] = len(s)
    return np.cumsum(sizes), np.concatenate(out) if out else np.zeros(0, np.uint64)
