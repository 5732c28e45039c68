"""A fixed public piece vocabulary as a double-array trie, and lattices of its pieces.

The space marker is the single byte 0xFF inside the trie (no UTF-8 text holds
it), so a literal U+2581 in a text is never confused with a space.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MARK = 0xFF
#: Where the box keeps the vocabulary; every entry point takes the path as a parameter.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A character without a piece costs this much more than the rarest piece (the usual unigram penalty).
UNKNOWN_PENALTY = 10.0
#: Zipf's shift: the piece of rank r has probability proportional to 1 / (r + SHIFT).
SHIFT = 10.0
#: Bytes of a chunk from which it is taken apart where no piece lies across, and from which what is left is walked along by itself.
LONG = 256
#: Bytes looked at together in a long chunk, and a byte that is in no piece.
BLOCK, STOP = 1 << 16, 0xFE
#: Bytes after which a sum is scaled along a single chunk, and over many chunks at once.
STEP, SCALE = 16, 48


@dataclass
class Trie:
    """``base``/``check`` double array over bytes; ``piece`` is the id that ends at a node, or -1."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    longest: int

    @staticmethod
    def build(keys: list[tuple[bytes, int]]) -> "Trie":
        keys = sorted(keys)
        size = 1 << 12
        base, check, piece = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        low = 1
        stack = [(0, 0, len(keys), 0)]  # node, keys from, keys to, depth
        while stack:
            node, lo, hi, depth = stack.pop()
            if len(keys[lo][0]) == depth:
                piece[node] = keys[lo][1]
                lo += 1
            if lo >= hi:
                continue
            children, at = [], lo
            while at < hi:
                byte, to = keys[at][0][depth], at
                while to < hi and keys[to][0][depth] == byte:
                    to += 1
                children.append((byte, at, to))
                at = to
            while low < size and check[low] >= 0:
                low += 1
            b, tries = max(1, low - children[0][0]), 0
            while True:
                top = b + 256
                if top >= size:
                    base += [0] * size
                    check += [-1] * size
                    piece += [-1] * size
                    size *= 2
                if all(check[b + c[0]] < 0 for c in children):
                    break
                b += 1
                tries += 1
                if tries == 2000:  # the first free slots suit nobody by now
                    low = b + children[0][0]
            base[node] = b
            for byte, _, _ in children:
                check[b + byte] = node
            stack += [(b + byte, x, y, depth + 1) for byte, x, y in children]
        used = max(i for i, c in enumerate(check) if c >= 0) + 257
        a = lambda x: np.array((x + [-1] * 257)[:used], dtype=np.int32)
        return Trie(a(base), a(check), a(piece), max(len(k) for k, _ in keys))

    def get(self, key: bytes) -> int:
        """The id of ``key``, or -1."""
        node = 0
        for byte in key:
            to = self.base[node] + byte
            if self.check[to] != node or to == 0:
                return -1
            node = int(to)
        return int(self.piece[node])


@dataclass
class Vocabulary:
    trie: Trie
    log_score: np.ndarray  # by id; -inf for ids that are no pieces of text
    byte_id: np.ndarray  # by byte
    text: np.ndarray  # bytes of all pieces, one after the other; the marker is MARK
    text_start: np.ndarray
    alone: np.ndarray  # by byte: True if the byte is in no piece of two or more characters

    @property
    def size(self) -> int:
        return len(self.log_score)

    @property
    def unknown(self) -> float:
        return float(self.log_score[np.isfinite(self.log_score)].min()) - UNKNOWN_PENALTY


@lru_cache(maxsize=2)
def load(path: str = VOCABULARY) -> Vocabulary:
    """Read a vocabulary.  Its pieces are in merge order, from which Zipf's law gives log scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    rank, raw, byte_id = np.full(n, np.inf), [b""] * n, np.full(256, -1, dtype=np.int32)
    keys, alone = [], np.ones(256, dtype=bool)
    for i in range(n):
        s = m.id_to_piece(i)
        if m.is_byte(i):
            byte_id[int(s[1:-1], 16)] = i
            raw[i] = bytes([int(s[1:-1], 16)])
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            raw[i] = b"".join(bytes([MARK]) if c == "▁" else c.encode() for c in s)
            rank[i] = -m.get_score(i)
            keys.append((raw[i], i))
            if len(s) > 1:
                alone[list(raw[i])] = False
            if any(raw[i][j] == MARK != raw[i][j - 1] for j in range(1, len(raw[i]))):
                raise ValueError(f"piece {s!r} has a space marker after another character")
    weight = 1 / (rank + SHIFT)
    with np.errstate(divide="ignore"):
        score = np.log(weight / weight.sum())
    starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    alone[0x80:] = False
    return Vocabulary(Trie.build(keys), score, byte_id, np.frombuffer(b"".join(raw), dtype=np.uint8), starts, alone)


_WIDTH = np.repeat([1, 0, 2, 3, 4, 1], [0x80, 0x40, 0x20, 0x10, 8, 8])


def char_lengths(lead: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character by its first byte; 0 for a continuation byte, 1 for bytes that no UTF-8 text holds."""
    return _WIDTH[lead]


def free_cuts(trie: Trie, buf: np.ndarray) -> np.ndarray:
    """True at the bytes in front of which every segmentation of ``buf`` has a cut, as no piece or character lies across."""
    n, reach = len(buf), 0
    out = np.zeros(n, dtype=bool)
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        d = buf[lo : min(hi + trie.longest, n)]
        at = np.arange(hi - lo)
        width = char_lengths(d[: hi - lo])
        end = at + np.maximum(width, 1)
        origin, node = np.flatnonzero(width), np.zeros(np.count_nonzero(width), dtype=np.int32)
        for k in range(trie.longest):
            inside = origin + k < len(d)
            origin, node = origin[inside], node[inside]
            to = trie.base[node] + d[origin + k]
            ok = (trie.check[to] == node) & (to > 0)
            origin, node = origin[ok], to[ok]
            if not len(origin):
                break
            hit = origin[trie.piece[node] >= 0]
            end[hit] = np.maximum(end[hit], hit + k + 1)
        far = np.maximum.accumulate(np.maximum(end, reach - lo))
        out[lo:hi] = np.append(reach - lo, far[:-1]) <= at
        reach = lo + int(far[-1])
    return out


def take_apart(trie: Trie, buf: np.ndarray, offsets: np.ndarray, limit: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, owner): chunks of more than ``limit`` bytes cut where every segmentation is; ``owner`` is the chunk each part is of."""
    sizes = np.diff(offsets)
    long_ = np.flatnonzero(sizes > limit)
    if not len(long_):
        return offsets, np.arange(len(sizes))
    cuts = [offsets]
    for lo, hi in _groups(sizes[long_]):
        own = long_[lo:hi]
        # A byte that is in no piece keeps pieces from reaching over to the next chunk.
        at = np.cumsum(sizes[own] + 1) - sizes[own] - 1
        joined = np.full(int((sizes[own] + 1).sum()), STOP, dtype=np.uint8)
        for a, i in zip(at, own, strict=True):
            joined[a : a + sizes[i]] = buf[offsets[i] : offsets[i + 1]]
        free = np.flatnonzero(free_cuts(trie, joined) & (joined != STOP))
        which = np.searchsorted(at, free, side="right") - 1
        cuts.append(offsets[own[which]] + free - at[which])
    new = np.unique(np.concatenate(cuts))
    return new, np.searchsorted(offsets, new[:-1], side="right") - 1


def _groups(sizes: np.ndarray):
    lo = 0
    for hi in [*(np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 20))) + 1).tolist(), len(sizes)]:
        yield lo, hi
        lo = hi


def edges_by_place(trie: Trie, buf: np.ndarray):
    """For each BLOCK of a chunk: first byte, and its pieces' (place within the block, length, id) by place and length; id -1 is a character without a piece."""
    n = len(buf)
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        d = buf[lo : min(hi + trie.longest, n)]
        width = char_lengths(d[: hi - lo])
        origin = np.flatnonzero(width)
        alone = np.minimum(width, n - lo - np.arange(hi - lo))
        node, single, found = np.zeros(len(origin), dtype=np.int32), width > 0, []
        for k in range(trie.longest):
            inside = origin + k < len(d)
            origin, node = origin[inside], node[inside]
            to = trie.base[node] + d[origin + k]
            ok = (trie.check[to] == node) & (to > 0)
            origin, node = origin[ok], to[ok]
            if not len(origin):
                break
            hit = trie.piece[node] >= 0
            p = origin[hit]
            found.append(np.stack([p, np.full(len(p), k + 1), trie.piece[node[hit]]]))
            single[p[width[p] == k + 1]] = False
        p = np.flatnonzero(single)
        found.append(np.stack([p, alone[p], np.full(len(p), -1)]))
        edge = np.concatenate(found, axis=1)
        yield lo, hi, edge[:, np.lexsort((edge[1], edge[0]))]


def walk_best(v: Vocabulary, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi along one long chunk: (lengths, ids) of the best path's pieces, memory a few bytes a byte; among equals the shortest last piece."""
    n = len(buf)
    back_size, back_id = np.zeros(n + 1, dtype=np.uint8), np.zeros(n + 1, dtype=np.int32)
    score = [*v.log_score.tolist(), v.unknown]
    reach, low = v.trie.longest + 4, float("-inf")
    value, sizes, ids = [0.0] + [low] * reach, [0] * (reach + 1), [0] * (reach + 1)  # from the block's first byte on
    for lo, hi, edge in edges_by_place(v.trie, buf):
        value += [low] * (hi - lo)
        sizes += [0] * (hi - lo)
        ids += [0] * (hi - lo)
        for p, size, i in zip(*edge.tolist(), strict=True):
            x, to = value[p] + score[i], p + size
            if x >= value[to] and x > low:
                value[to], sizes[to], ids[to] = x, size, i
        m = hi - lo
        back_size[lo : hi + 1], back_id[lo : hi + 1] = sizes[: m + 1], ids[: m + 1]
        value, sizes, ids = value[m:], sizes[m:], ids[m:]
    at, out = n, []
    while at:
        out.append(at)
        at -= int(back_size[at])
    ends = np.array(out[::-1], dtype=np.int64)
    return back_size[ends].astype(np.int64), back_id[ends]


def walk_sum(trie: Trie, prob: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """(models,): log of the sum over all segmentations of one long chunk, scaled on the way."""
    out, n = np.zeros(prob.shape[1]), len(buf)
    reach = trie.longest + 4
    for j in range(prob.shape[1]):
        p_of = prob[:, j].tolist()
        value, scale = [1.0] + [0.0] * reach, 0.0
        for lo, hi, edge in edges_by_place(trie, buf):
            m = hi - lo
            value += [0.0] * m
            bound = np.searchsorted(edge[0], np.arange(0, m + STEP, STEP))
            for i, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)):
                for p, size, piece in zip(*edge[:, a:b].tolist(), strict=True):
                    value[p + size] += value[p] * p_of[piece]
                at = min((i + 1) * STEP, m)
                top = max(value[at : at + reach + 1])
                scale += math.log(top)
                value[at : at + reach + 1] = [x / top for x in value[at : at + reach + 1]]
            value = value[m:]
        out[j] = scale + math.log(value[0])
    return out


class Lattice:
    """All pieces in a set of byte chunks, ordered so that sums and maxima run over all chunks at once.

    Edge i spans ``length[i]`` bytes, has id ``piece[i]`` (-1: a character without
    a piece) and leads from slot ``src[i]`` to ``dst[i]``; chunk c owns the slots
    ``first[c]`` to ``last[c]``.  ``steps`` lists edge ranges by distance from the
    chunk's start with the bounds of equal targets in each.
    """

    def __init__(self, trie: Trie, buf: np.ndarray, offsets: np.ndarray):
        i4 = np.int32
        n, sizes = len(buf), np.diff(offsets)
        chunk = np.repeat(np.arange(len(sizes), dtype=i4), sizes)
        limit = offsets[1:].astype(i4)[chunk]
        width = char_lengths(buf).astype(np.int8)
        origin = np.flatnonzero(width).astype(i4)
        node = np.zeros(len(origin), dtype=i4)
        pos, length, piece = [], [], []
        single = np.zeros(n, dtype=bool)
        for k in range(trie.longest):
            to = trie.base[node] + buf[origin + k]
            ok = (trie.check[to] == node) & (to > 0)
            origin, node = origin[ok], to[ok]
            if not len(origin):
                break
            end = trie.piece[node]
            hit = end >= 0
            p = origin[hit]
            pos.append(p)
            length.append(np.full(len(p), k + 1, dtype=i4))
            piece.append(end[hit])
            single[p[width[p] == k + 1]] = True
            more = origin + (k + 1) < limit[origin]
            origin, node = origin[more], node[more]
        p = np.flatnonzero((width > 0) & ~single).astype(i4)
        pos.append(p)
        length.append(np.minimum(width[p], limit[p] - p).astype(i4))
        piece.append(np.full(len(p), -1, dtype=i4))
        p, size, piece = (np.concatenate(x) for x in (pos, length, piece))
        del pos, length, limit, single, width
        start = offsets[:-1].astype(i4)
        order = np.argsort((p + size - start[chunk[p]]).astype(np.int64) * (n + 1) + (p + size), kind="stable").astype(i4)
        self.pos, self.length, self.piece = p[order], size[order], piece[order]
        del p, size, piece, order
        own = chunk[self.pos]
        self.src = self.pos + own
        self.dst = self.src + self.length
        self.first = (offsets[:-1] + np.arange(len(sizes))).astype(i4)
        self.last = self.first + sizes.astype(i4)
        self.slots = n + len(sizes)
        run = np.flatnonzero(np.diff(self.dst, prepend=i4(-1)) != 0)
        depth = (self.dst - self.first[own])[run]
        cut = np.searchsorted(depth, np.arange(1, (int(depth[-1]) if len(run) else 0) + 2))
        self.steps = [(run[a:b], int(run[a]), int(run[b]) if b < len(run) else len(self.dst)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]
        self.depths = (np.flatnonzero(np.diff(cut)) + 1).tolist()
        self.longest = trie.longest

    def best(self, score: np.ndarray, unknown: float) -> np.ndarray:
        """Viterbi: the edge by which the best path reaches each slot (-1: none); among equals the shortest."""
        value = np.full(self.slots, -np.inf)
        value[self.first] = 0.0
        back = np.full(self.slots, -1, dtype=np.int64)
        score = np.append(score, unknown)  # piece -1
        for run, lo, hi in self.steps:
            c = value[self.src[lo:hi]] + score[self.piece[lo:hi]]
            top = np.maximum.reduceat(c, run - lo)
            sizes = np.diff(np.append(run, hi))
            where = np.where(c == np.repeat(top, sizes), np.arange(lo, hi), hi)
            target = self.dst[run]
            value[target] = top
            back[target] = np.minimum.reduceat(where, run - lo)
        return back

    def weights(self, prob: np.ndarray, gain: float, lo: int, hi: int) -> np.ndarray:
        """(edges, models) of edges lo:hi; ``prob`` is (pieces + 1, models), each byte is scaled by ``gain``."""
        return prob[self.piece[lo:hi]] * (gain ** self.length[lo:hi])[:, None]

    def forward(self, prob: np.ndarray, gain: float) -> np.ndarray:
        """(slots, models): sums over all segmentations up to each slot."""
        value = np.zeros((self.slots, prob.shape[1]))
        value[self.first] = 1.0
        for run, lo, hi in self.steps:
            value[self.dst[run]] = np.add.reduceat(value[self.src[lo:hi]] * self.weights(prob, gain, lo, hi), run - lo, axis=0)
        return value

    def forward_log(self, prob: np.ndarray, gain: float) -> np.ndarray:
        """(chunks, models): log of the sums over all segmentations of whole chunks, scaled on the way."""
        value = np.zeros((self.slots, prob.shape[1]))
        value[self.first] = 1.0
        size = self.last - self.first
        scale = -size[:, None] * np.log(gain) + np.zeros((1, prob.shape[1]))
        for depth, (run, lo, hi) in zip(self.depths, self.steps, strict=True):
            value[self.dst[run]] = np.add.reduceat(value[self.src[lo:hi]] * self.weights(prob, gain, lo, hi), run - lo, axis=0)
            if depth % SCALE == 0 and len(live := np.flatnonzero(size > depth)):
                # No piece reaches from before these slots to after them.
                near = self.first[live][:, None] + np.arange(max(0, depth - max(self.longest, 4) + 1), depth + 1)
                top = value[near].max(axis=1)
                value[near] /= top[:, None]
                scale[live] += np.log(top)
        return np.log(value[self.last]) + scale

    def backward(self, prob: np.ndarray, gain: float) -> np.ndarray:
        """The same from each slot to its chunk's end."""
        value = np.zeros((self.slots, prob.shape[1]))
        value[self.last] = 1.0
        for _, lo, hi in reversed(self.steps):
            value[self.src[lo:hi]] += value[self.dst[lo:hi]] * self.weights(prob, gain, lo, hi)
        return value
