"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping chunks that together
cover the whole document; each filter's largest response in a chunk passes a
rectifier; the chunks' vectors are averaged and combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm import textnum as tn
from skerry.llm.sampling import held_out, low_rows, window

#: Bytes of a chunk and between chunk starts; bytes of a filter and between its positions.
CHUNK, HOP, WIDTH, STRIDE = 256, 192, 6, 2
EMBED, FILTERS = 6, 32
#: Labelled documents that the fit reads at most, characters and chunks of each, rounds and seed.
SAMPLE, CHARACTERS, CHUNKS, ROUNDS, SEED = 1600, 20_000, 8, 14, 5
CUT = 0.3


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED); row 0 is also the padding
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the chunks that cover each row; an empty row has one empty chunk."""
    sizes = np.diff(offsets)
    n = 1 + np.maximum(0, -(-(sizes - CHUNK) // HOP))
    row = np.repeat(np.arange(len(sizes)), n)
    return row, offsets[:-1][row] + HOP * tn.ragged(np.zeros(len(n), np.int64), n)


def gather(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes, zero past a row's end."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < offsets[row + 1][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(at.shape, np.uint8)


def _columns(x: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK, EMBED) to (chunks * positions, WIDTH * EMBED)."""
    n = len(x)
    flat = x.reshape(n, CHUNK * EMBED)
    view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
    return view.reshape(-1, WIDTH * EMBED)


def pooled(net: Network, x: np.ndarray, index: bool = False):
    """(chunks, FILTERS) largest responses, rectified; with ``index`` also their positions."""
    y = (_columns(net.embed[x]) @ net.filters).reshape(len(x), -1, FILTERS)
    top = y.max(axis=1) + net.bias
    return (np.maximum(top, 0), y.argmax(axis=1)) if index else np.maximum(top, 0)


def probability(net: Network, vector: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(vector @ net.out + net.shift, -30, 30)))


def gradients(net: Network, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean logistic loss, its gradients) of documents with ``sizes`` chunks each, ``x`` being (chunks, CHUNK) bytes."""
    f = np.float32
    h, where = pooled(net, x, index=True)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    mean = np.add.reduceat(h, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
    p = probability(net, mean)
    d = ((p - labels) / len(sizes)).astype(f)
    dh = (d[:, None] * net.out / sizes[:, None]).astype(f)[doc] * (h > 0)
    # Only the largest response of a filter in a chunk has a gradient.
    at = where * STRIDE
    seen = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # (chunks, FILTERS, WIDTH)
    e = net.embed[seen].reshape(len(x), FILTERS, WIDTH * EMBED)
    g = {"out": mean.T @ d, "shift": d.sum(keepdims=True), "bias": dh.sum(axis=0), "filters": np.einsum("nf,nfk->kf", dh, e)}
    de = (dh[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    g["embed"] = np.stack([np.bincount(seen.reshape(-1), de[:, j], minlength=256) for j in range(EMBED)], axis=1)
    loss = -np.mean(np.log(np.where(labels > 0, p, 1 - p)))
    return float(loss), {k: v.astype(f) for k, v in g.items()}


def fit(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS) -> Network:
    """Logistic loss by Adam, a few chunks of each text, evenly spread."""
    rng = np.random.default_rng(SEED)
    f = np.float32
    net = Network((0.5 * rng.standard_normal((256, EMBED))).astype(f), (rng.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED / 4)).astype(f), np.zeros(FILTERS, f), (0.1 * rng.standard_normal(FILTERS)).astype(f), 0.0)
    if not texts:
        return net
    data, offsets = tn.buffers(pa.array(texts, pa.large_string()))
    row, start = chunks(offsets)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    own = [np.unique(np.linspace(a, b - 1, min(CHUNKS, b - a)).astype(np.int64)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    params = {"embed": net.embed, "filters": net.filters, "bias": net.bias, "out": net.out, "shift": np.zeros(1, f)}
    first, second, t = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 32)):
            pick = np.concatenate([own[i] for i in part])
            _, g = gradients(net, gather(data, offsets, row[pick], start[pick]), np.array([len(own[i]) for i in part]), labels[part])
            t += 1
            for k, v in params.items():
                grad = g[k] + f(1e-5) * v
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad**2 - second[k])
                v -= 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            net.shift = float(params["shift"][0])
    return net


def score_block(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each text of a block."""
    row, start = chunks(offsets)
    n = len(offsets) - 1
    total = np.zeros((n, FILTERS))
    for i in range(0, len(row), 256):
        own = slice(i, i + 256)
        np.add.at(total, row[own], pooled(net, gather(data, offsets, row[own], start[own])))
    return probability(net, total / np.bincount(row, minlength=n)[:, None])


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            data, offsets = tn.buffers(batch.column(1))
            for lo, hi in tn.blocks(offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score_block(net, data, offsets[lo : hi + 1]))], ["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on a window of at most CHARACTERS of each of the ``sample`` labelled documents lowest by a hash of doc_id; a doc_id with several labels counts as 1 if any is."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    ids = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id")).join(marks, "doc_id")
    ids = low_rows(ids, sample).distinct().orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").where("text is not null")
    rows = rows.select("doc_id", "y", window("text", "doc_id", CHARACTERS).alias("text"))
    rows = sorted((r.doc_id, r.y, r.text) for r in rows.toLocalIterator())[:sample]
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], dtype=np.float32))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """One row per document: doc_id, score (probability of quality 1), predicted (1 from ``CUT`` on).

    ``docs`` has doc_id (long, may be null) and text; other columns are not read.  A
    null text is scored as an empty one.  Repeated rows are each returned; an empty
    table gives an empty result.  Very long texts are scored whole, a few chunks at a
    time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(shared), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op8_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels of those that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = train(docs.where(~held_out("doc_id")), labels)
    return score(docs, net).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
