"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.  A
word's probability is the sum over all its segmentations into pieces (forward
algorithm); a text's is the product over its words.  The piece probabilities are
fitted by expectation maximisation (expected piece counts from forward and
backward sums) on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import textnum as tn
from skerry.llm.pieces import LONG, MARK, VOCABULARY, Lattice, Vocabulary, load, take_apart, walk_sum
from skerry.llm.sampling import held_out, low_rows, window

#: Labelled documents per language that the fit reads at most, characters of each, and its rounds.
SAMPLE, CHARACTERS, ROUNDS = 300, 20_000, 4
#: Weight, in pieces, of the languages' common distribution in each language's own.
PRIOR = 200.0
#: Bytes of a word beyond which it is taken apart (and is not fitted on); in sums each byte is scaled by GAIN.
LINEAR, GAIN = 64, 6.0
#: All bytes but ASCII letters and the bytes of other characters part words.
NOT_LETTERS = tuple(b for b in range(128) if not chr(b).isalpha())
SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass
class Model:
    languages: list[str]  # sorted
    prob: np.ndarray  # (pieces + 1, languages); the last row is for characters without a piece


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[tn.Words, np.ndarray, np.ndarray, np.ndarray]:
    """A block's words, and its distinct words as marked chunks: (words, inverse, bytes, offsets)."""
    w = tn.words(data, offsets, NOT_LETTERS, lower=False)
    first, inverse = tn.distinct(data, w.start, w.end, w.hash)
    sizes = w.end[first] - w.start[first]
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    buf = np.full(int(bounds[-1]), MARK, dtype=np.uint8)
    buf[tn.ragged(bounds[:-1] + 1, sizes)] = data[tn.ragged(w.start[first], sizes)]
    return w, inverse, buf, bounds


def word_scores(v: Vocabulary, prob: np.ndarray, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations.

    The sum of a long word is the product over its parts between places that no
    piece lies across; a part that is still long is walked along by itself.
    """
    parts, owner = take_apart(v.trie, buf, bounds, LINEAR)
    sizes = np.diff(parts)
    out = np.empty((len(sizes), prob.shape[1]))
    short = sizes <= LONG
    if short.any():
        out[short] = Lattice(v.trie, buf[tn.ragged(parts[:-1][short], sizes[short])], np.concatenate([[0], np.cumsum(sizes[short])])).forward_log(prob, GAIN)
    for i in np.flatnonzero(~short):
        out[i] = walk_sum(v.trie, prob, buf[parts[i] : parts[i + 1]])
    return out if len(parts) == len(bounds) else np.add.reduceat(out, np.searchsorted(owner, np.arange(len(bounds) - 1)), axis=0)


def fit(v: Vocabulary, texts: dict[str, list[str]], rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language by expectation maximisation over its distinct words."""
    languages = sorted(texts)
    lattices = []
    for lang in languages:
        col = pc.utf8_lower(pa.array(texts[lang], pa.large_string()))
        data, offsets = tn.buffers(col)
        _, inverse, buf, bounds = _words(data, offsets)
        count = np.bincount(inverse, minlength=len(bounds) - 1)
        fits = np.diff(bounds) <= LINEAR
        sizes = np.diff(bounds)[fits]
        lattices.append((Lattice(v.trie, buf[tn.ragged(bounds[:-1][fits], sizes)], np.concatenate([[0], np.cumsum(sizes)])), count[fits], sizes))
    prob = np.full((v.size + 1, len(languages)), 1.0 / v.size)
    for _ in range(rounds):
        counts = np.zeros_like(prob)
        for i, (lattice, count, sizes) in enumerate(lattices):
            own = prob[:, i : i + 1]
            forward, backward = lattice.forward(own, GAIN)[:, 0], lattice.backward(own, GAIN)[:, 0]
            p = lattice.weights(own, GAIN, 0, len(lattice.piece))
            each = np.repeat(count / forward[lattice.last], sizes + 1)
            expected = forward[lattice.src] * p[:, 0] * backward[lattice.dst] * each[lattice.src]
            counts[:, i] = np.bincount(np.where(lattice.piece < 0, v.size, lattice.piece), expected, minlength=v.size + 1)
        common = counts.sum(axis=1) + 0.01
        common /= common.sum()
        prob = (counts + PRIOR * common[:, None]) / (counts.sum(axis=0) + PRIOR)
    return Model(languages, prob)


def predict_block(v: Vocabulary, model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language's index, its posterior) of each lower-cased text."""
    n, k = len(offsets) - 1, len(model.languages)
    total = np.zeros((n, k))
    whole = n > 1 or offsets[-1] - offsets[0] <= 2 * tn.BLOCK
    for part in [offsets] if whole else map(np.array, tn.row_parts(data, int(offsets[0]), int(offsets[-1]), NOT_LETTERS)):
        w, inverse, buf, bounds = _words(data, part)
        if len(w.row):
            scores = word_scores(v, model.prob, buf, bounds)
            at = tn.row_starts(w.row, n)
            full = np.flatnonzero(np.diff(at))
            for j in range(k):
                total[full, j] += np.add.reduceat(scores[inverse, j], at[:-1][full])
    best = total.argmax(axis=1)
    return best, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = shared.value
        names = pa.array([*model.languages, "und"], pa.string())
        for batch in batches:
            text = batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            _, offsets = tn.buffers(text)
            for lo, hi in tn.blocks(offsets):
                if model.languages:
                    best, score = predict_block(v, model, *tn.buffers(pc.utf8_lower(text.slice(lo, hi - lo))))
                else:
                    best, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                known = letters[lo:hi]
                pick = np.where(known, best, len(model.languages))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), names.take(pa.array(pick)), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return run


def train(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> Model:
    """Fit on the rows of ``docs`` with text and lang: per language a window of at most CHARACTERS of each of the ``sample`` rows lowest by a hash of doc_id.

    So the driver holds 6 MB of characters a language at most.
    """
    labelled = docs.where("text is not null and lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)), "doc_id")
    chosen = low_rows(labelled, sample, "lang").distinct()
    chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("doc_id", "lang")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"]).where("text is not null")
    rows = rows.select("doc_id", "lang", window("text", "doc_id", CHARACTERS).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in sorted(rows.collect()):
        own = texts.setdefault(r.lang, [])
        if len(own) < sample:
            own.append(r.text)
    v = load(path)
    return fit(v, texts) if texts else Model([], np.zeros((v.size + 1, 0)))


def identify(docs: DataFrame, model: Model, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (posterior of the predicted language, equal priors).

    ``docs`` has doc_id (long, may be null) and text; no other column is read.  A
    null text or one without a letter gives ``und`` and 0.0, as does a model
    without languages.  Equal posteriors give the alphabetically first language.
    Repeated rows are each returned; an empty table gives an empty result.  Very long
    texts are scored whole, in parts of about a megabyte, with or without spaces.
    """
    shared = docs.sparkSession.sparkContext.broadcast((load(path), model))
    if not model.languages:
        docs = docs.withColumn("text", F.lit(None).cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(shared), SCHEMA)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, path: str = VOCABULARY) -> DataFrame:
    """The rows of ``docs``, all columns, that have a language with posterior ``least`` or more; ``und`` goes.

    A model without languages, as a table without labels gives, can tell no language
    from another: then only rows without a letter go.  Null ids, repeated rows and
    other columns, whatever their names, make no difference.
    """
    shared = docs.sparkSession.sparkContext.broadcast((load(path), model))
    text_at = docs.columns.index("text")
    identify_rows = _run(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            plain = pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], ["doc_id", "text"])
            scores = [x.column("score").to_numpy() for x in identify_rows(iter([plain]))]
            keep = np.concatenate(scores) if scores else np.zeros(0)  # und has score 0
            yield batch.filter(pa.array(keep >= max(least, 1e-12)))

    return docs.mapInArrow(run, docs.schema) if model.languages else docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
