"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of ones and zeros slide over the words; only words under a one are
hashed, so a seed still matches where ignored words were substituted.  A seed
shared by a document and a benchmark item fixes a diagonal, and the overlap on
it is verified word by word, tolerating substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import textnum as tn

#: The masks.  Found by greedy search so that every window of 13 words with any three substituted has a seed.
MASKS = ("11010111", "1110010011", "111111", "1110001101", "100101000111", "10110111")
#: Words of an overlap that are compared (a shorter item: all of it), and the percentage that must be equal.
WINDOW, PERCENT = 13, 75
#: Words of all benchmark items that one pass over the documents looks for.
PASS_WORDS = 1_000_000
#: Bytes between words: ASCII characters that are neither letter nor digit.
SEPARATORS = tuple(b for b in range(128) if not chr(b).isalnum())
#: Bits of the filter in front of the seed table.
FILTER_BITS = 22
#: Hits listed at a time.
HITS = 1 << 15
#: Words that an item must have to be searched for within texts.
LEAST = 4
#: A word, as SEPARATORS part them.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
SCHEMA = "doc_id long, item_id long, n_equal long, doc_word long, item_word long"


def _parts(n: int, percent: int) -> list[tuple[str, int]]:
    """(mask, offset) of seeds for items of n words: with e substitutions allowed, one of e + 1 disjoint parts stays whole."""
    parts = min(n, n - -(-percent * n // 100) + 1)
    cuts = [n * i // parts for i in range(parts + 1)]
    return [("1" * (b - a), a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _words(texts: pa.Array) -> tn.Words:
    """Words of the texts, in lower case and without ASCII punctuation, so that shouted or decorated copies count."""
    return tn.words(*tn.buffers(pc.utf8_lower(texts)), SEPARATORS, lower=False)


def _seed(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Seeds of all positions where the whole mask fits."""
    n = len(h) - len(mask) + 1
    c = tn.constants(64, 53)
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.full(n, number + 1, dtype=np.uint64) * c[63]
    for j, bit in enumerate(mask):
        if bit == "1":
            x += h[j : j + n] * c[j]
    return tn.mix(x)


class Index:
    """Seeds of a bounded block of benchmark items, sorted, behind a bit filter."""

    def __init__(self, ids: np.ndarray, hashes: list[np.ndarray], percent: int = PERCENT):
        self.ids, self.percent = ids, percent
        self.size = np.array([len(h) for h in hashes], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.words = np.concatenate([np.zeros(0, np.uint64), *hashes])
        # The masks are complete for whole windows only; a shorter item has parts of its own.
        short = {n: _parts(n, percent) for n in sorted({len(h) for h in hashes if 0 < len(h) < WINDOW})}
        self.masks = [*MASKS, *sorted({mask for parts in short.values() for mask, _ in parts} - set(MASKS))]
        number = {mask: m for m, mask in enumerate(self.masks)}
        every = [(mask, None) for mask in MASKS]
        seed, item, at = [], [], []
        for i, h in enumerate(hashes):
            for mask, offset in short.get(len(h), every):
                s = _seed(h, mask, number[mask])
                s, places = (s, np.arange(len(s))) if offset is None else (s[offset : offset + 1], np.array([offset]))
                seed.append(s)
                item.append(np.full(len(s), i))
                at.append(places)
        empty = [np.zeros(0, np.uint64)]
        self.seed = np.concatenate(seed or empty)
        order = np.argsort(self.seed, kind="stable")
        self.seed = self.seed[order]
        self.item = np.concatenate(item or empty).astype(np.int64)[order]
        self.at = np.concatenate(at or empty).astype(np.int64)[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.seed >> np.uint64(64 - FILTER_BITS)] = True

    def overlaps(self, h: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(5, pairs) row, item, equal words, word and item position of the best window of each pair that reaches the percentage.

        Every such window holds a seed, so it is enough to look at the windows around each hit.
        """
        best = np.zeros((5, 0), np.int64)
        for m, mask in enumerate(self.masks):
            s = _seed(h, mask, m)
            p = np.flatnonzero(self.filter[s >> np.uint64(64 - FILTER_BITS)])
            p = p[row[p] == row[p + len(mask) - 1]] if len(p) else p
            a = np.searchsorted(self.seed, s[p], side="left")
            n = np.searchsorted(self.seed, s[p], side="right") - a
            end = np.cumsum(n)
            # A frequent seed has many hits: HITS of them are listed at a time.
            for lo in range(0, int(end[-1]) if len(p) else 0, HITS):
                flat = np.arange(lo, min(lo + HITS, int(end[-1])))
                which = np.searchsorted(end, flat, side="right")
                found = self._windows(h, bounds, row[p[which]], a[which] + flat - (end - n)[which], p[which], len(mask))
                best = _best(np.concatenate([best, found], axis=1))
        return best

    def _windows(self, h: np.ndarray, bounds: np.ndarray, row: np.ndarray, entry: np.ndarray, p: np.ndarray, span: int) -> np.ndarray:
        """The best window that holds each hit's seed, of those hits that have one."""
        item, at = self.item[entry], self.at[entry]
        size, lo, hi = self.size[item], bounds[row], bounds[row + 1]
        width = np.minimum(size, WINDOW)
        diagonal = p - at
        start = np.maximum(0, at + span - width)
        reach = 2 * WINDOW - span
        j = start[:, None] + np.arange(reach)
        i = j + diagonal[:, None]
        inside = (j < size[:, None]) & (i >= lo[:, None]) & (i < hi[:, None])
        equal = inside & (h[np.where(inside, i, 0)] == self.words[np.where(inside, self.first[item][:, None] + j, 0)])
        total = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
        shift = np.arange(max(1, WINDOW - span + 1))
        first = start[:, None] + shift
        possible = (first <= at[:, None]) & (first + width[:, None] <= size[:, None]) & (first + diagonal[:, None] >= lo[:, None]) & (first + (diagonal + width)[:, None] <= hi[:, None])
        possible &= ((size >= LEAST) | (hi - lo == size))[:, None]
        count = np.where(possible, np.take_along_axis(total, np.minimum(shift + width[:, None], reach), axis=1) - total[:, shift], -1)
        top = count.argmax(axis=1)
        n = count[np.arange(len(p)), top]
        good = np.flatnonzero((n >= 0) & (100 * n >= self.percent * width))
        begin = start[good] + top[good]
        return np.stack([row[good], item[good], n[good], begin + diagonal[good] - lo[good], begin])


def _best(found: np.ndarray) -> np.ndarray:
    """Of each row and item the overlap with most equal words, then the first."""
    found = found[:, np.lexsort((found[4], found[3], -found[2], found[1], found[0]))]
    return found[:, np.flatnonzero((np.diff(found[0], prepend=-1) != 0) | (np.diff(found[1], prepend=-1) != 0))]


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            _, offsets = tn.buffers(text)
            for lo, hi in tn.blocks(offsets):
                w = _words(text.slice(lo, hi - lo))
                row, item, *rest = index.overlaps(w.hash, w.row, tn.row_starts(w.row, hi - lo))
                if len(row):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + row)), pa.array(index.ids[item]), *(pa.array(x) for x in rest)], ["doc_id", "item_id", "n_equal", "doc_word", "item_word"])

    return run


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (doc_id, item_id) of a document that holds a benchmark item's words, with the best overlap.

    A pair is returned once per row of ``docs`` if somewhere WINDOW consecutive words
    of the item (all words of a shorter item) agree with the document's, place by
    place, in ``percent`` per cent or more (75 at least): n_equal of them, from
    doc_word and item_word on (the first such window among equals).  Items of fewer
    than LEAST words say too little within a text: they match only a document that
    has their words and no other.  Words are runs of letters, digits and characters
    beyond ASCII, in lower case.  Null, empty and blank texts and items match
    nothing; null ids are kept as null doc_id, items without an id are left out; rows
    that repeat an item give its pair once per document row.  Other columns are not
    read; empty tables give an empty result.  Very long texts are searched whole.
    The benchmark is searched for in passes of about PASS_WORDS words, each broadcast
    as a table of that bounded size.
    """
    if percent < PERCENT:
        raise ValueError(f"the masks are complete from {PERCENT} per cent on")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // PASS_WORDS))
    out = None
    for i in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).distinct().orderBy("item_id", "text").collect()
        w = _words(pa.array([r.text for r in rows], pa.large_string()))
        bounds = tn.row_starts(w.row, len(rows))
        index = Index(np.array([r.item_id for r in rows], dtype=np.int64), [w.hash[bounds[j] : bounds[j + 1]] for j in range(len(rows))], percent)
        found = docs.mapInArrow(_run(spark.sparkContext.broadcast(index)), SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, as ``contaminated_pairs`` finds them; all columns and all rows without doc_id stay."""
    bad = contaminated_pairs(docs, benchmark, percent).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


OP9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS t FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS t
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
x AS (SELECT doc_id, len(t) AS m, unnest(t) AS w, unnest(range(len(t))) AS p FROM d),
y AS (SELECT item_id, len(t) AS n, least(13, len(t)) AS width, unnest(t) AS w, unnest(range(len(t))) AS j FROM b),
e AS (
  SELECT doc_id, m, item_id, n, width, p - j AS diagonal, list(j) AS js
  FROM x JOIN y USING (w) WHERE n >= 4 OR m = n GROUP BY ALL HAVING 100 * count(*) >= 75 * width),
s AS (SELECT *, unnest(range(greatest(0, -diagonal), least(n, m - diagonal) - width + 1)) AS a FROM e),
c AS (SELECT doc_id, item_id, width, len([j FOR j IN js IF j >= a AND j < a + width]) AS n_equal, a + diagonal AS doc_word, a AS item_word FROM s)
SELECT doc_id, item_id, n_equal, doc_word, item_word FROM c WHERE 100 * n_equal >= 75 * width
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, doc_word, item_word) = 1
"""


def op9_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) overlap that tolerates substitutions."""
    return contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
