"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie.

Text is taken as it is (no Unicode normalisation); a marker is put in front and
stands for every space.  No piece has a marker after another character, so text
splits exactly in front of such markers: each distinct chunk of a block of texts
is segmented once, all chunks at the same time.  Long chunks without a marker are
cut where no piece lies across, and what is still long is walked along piece by
piece.  Characters without a piece become their bytes' pieces, so decoding gives
back the very text.  Segmentations of equal score may be cut differently from
other libraries: the shortest last piece wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import textnum as tn
from skerry.llm.pieces import LONG, MARK, VOCABULARY, Lattice, Vocabulary, char_lengths, free_cuts, load, take_apart, walk_best

SCHEMA = "doc_id long, n_tokens long, n_fallback long, token_ids array<int>, round_trip boolean"


def _encode_chunks(v: Vocabulary, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, ids, bytes that fell back) of each chunk."""
    lattice = Lattice(v.trie, buf, offsets)
    back = lattice.best(v.log_score, v.unknown)
    n = len(offsets) - 1
    count, fell = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    path = []
    which, slot = np.arange(n), lattice.last.copy()
    while len(which):
        edge = back[slot]
        whole = lattice.piece[edge] < 0
        count[which] += np.where(whole, lattice.length[edge], 1)
        fell[which] += np.where(whole, lattice.length[edge], 0)
        path.append((which, edge))
        slot = lattice.src[edge]
        go = slot > lattice.first[which]
        which, slot = which[go], slot[go]
    bounds = np.concatenate([[0], np.cumsum(count)])
    ids = np.empty(int(bounds[-1]), dtype=np.int32)
    free = bounds[1:].copy()
    for which, edge in path:
        piece = lattice.piece[edge]
        known = piece >= 0
        free[which[known]] -= 1
        ids[free[which[known]]] = piece[known]
        for w, e in zip(which[~known], edge[~known], strict=True):
            free[w] -= lattice.length[e]
            p = lattice.pos[e]
            ids[free[w] : free[w] + lattice.length[e]] = v.byte_id[buf[p : p + lattice.length[e]]]
    return bounds, ids, fell


def _encode_marked(v: Vocabulary, buf: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, number of ids, bytes that fell back) of each chunk of marked texts that begin at ``head``, and all ids."""
    n = len(buf)
    lone = v.alone[buf]
    cut = np.zeros(n, dtype=bool)
    cut[head] = True
    cut[1:] |= ((buf[1:] == MARK) & (buf[:-1] != MARK)) | lone[1:] | lone[:-1]
    begin = np.flatnonzero(cut)
    begin = take_apart(v.trie, buf, np.append(begin, n))[0][:-1]
    end = np.append(begin[1:], n)
    first, inverse = tn.distinct(buf, begin, end, tn.hash_spans(buf, begin, end))
    sizes = (end - begin)[first]
    short = sizes <= LONG
    own = first[short]
    bounds, ids, fell_ = _encode_chunks(v, buf[tn.ragged(begin[own], sizes[short])], np.concatenate([[0], np.cumsum(sizes[short])])) if len(own) else (np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    count, at, fell = (np.zeros(len(first), dtype=np.int64) for _ in range(3))
    count[short], at[short], fell[short] = np.diff(bounds), bounds[:-1], fell_
    more, used = [ids], len(ids)
    for i in np.flatnonzero(~short):
        chunk = buf[begin[first[i]] : end[first[i]]]
        size, piece = walk_best(v, chunk)
        each = np.where(piece < 0, size, 1)
        out = np.repeat(piece, each)
        start = np.cumsum(size) - size
        unknown = piece < 0
        out[np.repeat(unknown, each)] = v.byte_id[chunk[tn.ragged(start[unknown], size[unknown])]]
        count[i], at[i], fell[i] = len(out), used, size[unknown].sum()
        more.append(out)
        used += len(out)
    ids = np.concatenate(more)
    return begin, count[inverse], fell[inverse], ids[tn.ragged(at[inverse], count[inverse])]


def _segments(v: Vocabulary, buf: np.ndarray):
    """Bounds of parts of about a block of one long marked text, cut where every segmentation is."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = lo + tn.BLOCK
        while hi < n:
            near = buf[hi : hi + tn.BLOCK]
            after = np.flatnonzero((near == MARK) & (buf[hi - 1 : hi - 1 + len(near)] != MARK))
            if not len(after):  # pieces that begin before the part may lie across its first bytes
                back = max(lo, hi - 2 * v.trie.longest)
                after = np.flatnonzero(free_cuts(v.trie, buf[back : hi + len(near)])[hi - back :][v.trie.longest :]) + v.trie.longest
                after = after[char_lengths(near[after]) > 0]
            if len(after):
                hi += int(after[0])
                break
            hi += tn.BLOCK
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def encode_block(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, ids, bytes that fell back) of each text of a block; an empty text has no ids."""
    lo, n_rows = int(offsets[0]), len(offsets) - 1
    raw, rel = data[lo : int(offsets[-1])], offsets - lo
    full = (np.diff(rel) > 0).astype(np.int64)
    start = rel + np.concatenate([[0], np.cumsum(full)])  # one marker more in front of each text
    n = int(start[-1])
    if not n:
        return np.zeros(n_rows + 1, np.int64), np.zeros(0, np.int32), np.zeros(n_rows, np.int64)
    buf = np.empty(n, dtype=np.uint8)
    own = np.ones(n, dtype=bool)
    head = start[:-1][full > 0]
    own[head] = False
    buf[own] = np.where(raw == 32, np.uint8(MARK), raw)
    buf[head] = MARK
    del own
    if n_rows == 1 and n > 2 * tn.BLOCK:
        parts = [_encode_marked(v, buf[a:b], np.zeros(1, np.int64)) for a, b in _segments(v, buf)]
        ids = np.concatenate([p[3] for p in parts])
        return np.array([0, len(ids)]), ids, np.array([sum(int(p[2].sum()) for p in parts)])
    begin, per_chunk, fell, out = _encode_marked(v, buf, head)
    at = np.searchsorted(begin, start)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])[at]
    return sums(per_chunk), out, np.diff(sums(fell))


def decode_block(v: Vocabulary, bounds: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts; ids outside the vocabulary and control ids stand for nothing."""
    ids = np.where((ids >= 0) & (ids < v.size), ids, 0)
    sizes = np.diff(v.text_start)[ids]
    raw = v.text[tn.ragged(v.text_start[ids], sizes)]
    at = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    raw = np.where(raw == MARK, np.uint8(32), raw)
    drop = np.zeros(len(raw), dtype=bool)
    begun = at[:-1][(np.diff(at) > 0)]
    drop[begun[raw[begun] == 32]] = True
    gone = np.concatenate([[0], np.cumsum(drop)])
    return at - gone[at], raw[~drop]


def encode(texts: list[str], path: str = VOCABULARY) -> list[list[int]]:
    v = load(path)
    data, offsets = tn.buffers(pa.array(texts, pa.large_string()))
    bounds, ids, _ = encode_block(v, data, offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def decode(ids: list[list[int]], path: str = VOCABULARY) -> list[str]:
    """Texts of id lists; byte pieces that form no UTF-8 become U+FFFD."""
    v = load(path)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    at, raw = decode_block(v, bounds, np.array([i for x in ids for i in x], dtype=np.int64))
    return [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            data, offsets = tn.buffers(batch.column(1))
            for lo, hi in tn.blocks(offsets):
                part = offsets[lo : hi + 1]
                bounds, ids, fell = encode_block(v, data, part)
                at, raw = decode_block(v, bounds, ids)
                want = data[int(part[0]) : int(part[-1])]
                same = np.diff(at) == np.diff(part)
                if not (same.all() and np.array_equal(raw, want)):
                    rel = part - part[0]
                    same = np.array([s and np.array_equal(raw[at[i] : at[i + 1]], want[rel[i] : rel[i + 1]]) for i, s in enumerate(same)], dtype=bool)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(fell), lists, pa.array(same)], ["doc_id", "n_tokens", "n_fallback", "token_ids", "round_trip"])

    return run


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_fallback, token_ids, round_trip (decoding gives the text back).

    ``docs`` has doc_id (long, may be null) and text; other columns are not read.
    Null and empty texts have no ids and count as a round trip.  Repeated rows are
    each returned; an empty table gives an empty result.  A very long text is taken
    in parts of about a megabyte, with or without spaces, and gives the ids of the
    whole.  The vocabulary (fixed, a few MB) is read on the driver from ``path`` and
    broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(shared), SCHEMA)


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of a table with doc_id and token_ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            ids = batch.column(1)
            texts = []
            for i in range(len(ids)):
                if not ids[i].is_valid:
                    texts.append(None)
                    continue
                own = ids[i].values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts.append(decode_block(v, np.array([0, len(own)]), own)[1].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")


def op10_piece_codec(spark, sf_dir: str) -> DataFrame:
    """Every document's piece ids, with the check that they decode to its text."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
