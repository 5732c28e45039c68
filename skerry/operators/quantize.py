"""Scalar and product quantisation, and search on codes with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.errors import DimensionMismatch
from skerry.functions import distance as D

OVERSAMPLE = 10
#: Vectors that a product quantiser is fitted on at most, codewords, rounds and seed.
SAMPLE, CODEWORDS, ROUNDS, SEED = 20_000, 256, 25, 42


# --- scalar, one byte a dimension ---


def sq8_train(vectors: DataFrame) -> DataFrame:
    """(pos, low, scale): minimum and (maximum - minimum) / 255 of every dimension; partial minima in every task."""
    each = vectors.select(F.posexplode(D.vector(F.col("vector"))).alias("pos", "x"))
    return each.groupBy("pos").agg(F.min("x").alias("low"), ((F.max("x") - F.min("x")) / 255.0).alias("scale"))


def sq8_model(trained: DataFrame) -> tuple[list[float], list[float]]:
    """Lows and scales on the driver: one row a dimension."""
    rows = sorted(trained.collect())
    return [r.low for r in rows], [r.scale for r in rows]


def _model(model: tuple[Sequence[float], Sequence[float]]) -> Column:
    return F.arrays_zip(D.vector(model[0]).alias("low"), D.vector(model[1]).alias("scale"))


def sq8_encode(v: Column, model) -> Column:
    """Codes 0 to 255: rounded half away from zero, clamped; 0 where the scale is 0."""
    code = lambda x, m: F.when(m["scale"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round((x - m["low"]) / m["scale"])))).cast("short")
    return F.zip_with(v, _model(model), code)


def sq8_decode(codes: Column, model) -> Column:
    return F.zip_with(codes, _model(model), lambda c, m: m["low"] + c * m["scale"])


def sq8_distance(query: Sequence[float], codes: Column, model) -> Column:
    """Squared distance of an unquantised query to a code."""
    return D.l2_squared(D.vector(query), sq8_decode(codes, model))


SQ8_COMPRESSION = 4.0


def rerank(candidates: DataFrame, vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Exact top k of candidate ids; the candidates are a bounded list."""
    own = vectors.join(F.broadcast(candidates.select("id")), "id", "left_semi")
    d = D.l2_squared(D.vector(F.col("vector")), D.vector(query))
    return own.select("id", d.alias("distance")).orderBy("distance", "id").limit(k)


def quantized_search(codes: DataFrame, distance: Column, vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Top 10 k by code distance, reranked exactly."""
    wide = codes.select("id", distance.alias("approx")).orderBy("approx", "id").limit(OVERSAMPLE * k)
    return rerank(wide, vectors, query, k)


# --- product ---


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids; fewer distinct rows leave the rest zero."""
    n = len(x)
    out = np.zeros((k, x.shape[1]))
    if n <= k:
        out[:n] = x
        return out
    out[:] = x[rng.choice(n, k, replace=False)]
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ out.T + (out**2).sum(1)).argmin(axis=1)
        size = np.bincount(near, minlength=k)
        new = np.stack([np.bincount(near, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1) / np.maximum(size, 1)[:, None]
        if np.allclose(new, out):
            break
        out = new
    return out


def sample_matrix(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The vectors of the ``sample`` rows lowest by a hash of id."""
    rows = vectors.select("id", D.vector(F.col("vector")).alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    return rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def pq_fit(x: np.ndarray, m: int = 8, codewords: int = CODEWORDS) -> np.ndarray:
    """(m, codewords, dim / m) codebook of the rows of x."""
    if x.shape[1] % m:
        raise DimensionMismatch(f"{x.shape[1]} dimensions can't be cut into {m} parts")
    rng, width = np.random.default_rng(SEED), x.shape[1] // m
    return np.stack([kmeans(x[:, i * width : (i + 1) * width], codewords, ROUNDS, rng) for i in range(m)])


def pq_train(vectors: DataFrame, m: int = 8, sample: int = SAMPLE, codewords: int = CODEWORDS) -> np.ndarray:
    """A codebook fitted on a bounded sample."""
    return pq_fit(sample_matrix(vectors, sample), m, codewords)


def pq_codes(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """(rows, m): the nearest codeword of every part, the lowest among equals."""
    m, _, width = codebook.shape
    x = x.reshape(len(x), m, width)
    codes = np.empty((len(x), m), dtype=np.int16)
    for i in range(m):
        total = np.zeros((len(x), codebook.shape[1]))
        for j in range(width):  # in order, as the columns sum
            d = x[:, i, j, None] - codebook[i, :, j]
            total += d * d
        codes[:, i] = total.argmin(axis=1)
    return codes


def code_lists(codes: np.ndarray) -> pa.Array:
    n, m = codes.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(codes.reshape(-1)))


def pq_encode(vectors: DataFrame, codebook: np.ndarray) -> DataFrame:
    """(id, codes): the nearest codeword of every part, the lowest among equals."""
    m, _, width = codebook.shape
    shared = vectors.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), code_lists(pq_codes(x.reshape(batch.num_rows, -1), shared.value))], ["id", "codes"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), D.vector(F.col("vector")).alias("v")).where(F.size("v") == m * width)
    return rows.mapInArrow(run, "id long, codes array<short>")


def pq_table(query: Sequence[float], codebook: np.ndarray) -> list[list[float]]:
    """Squared distances of the query's parts to every codeword."""
    q = np.asarray(query, dtype=np.float64).reshape(codebook.shape[0], 1, -1)
    total = np.zeros(codebook.shape[:2])
    for j in range(codebook.shape[2]):
        d = q[:, :, j] - codebook[:, :, j]
        total += d * d
    return total.tolist()


def pq_distance(codes: Column, table: list[list[float]]) -> Column:
    """Sum of table entries over the parts."""
    lookup = F.array(*(D.vector(row) for row in table))
    parts = F.zip_with(lookup, codes, lambda row, c: F.element_at(row, c.cast("int") + 1))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def pq_decode(codes: Column, codebook: np.ndarray) -> Column:
    book = F.array(*(F.array(*(D.vector(w) for w in part)) for part in codebook.tolist()))
    return F.flatten(F.zip_with(book, codes, lambda part, c: F.element_at(part, c.cast("int") + 1)))


def pq_compression(dim: int, m: int) -> float:
    return 4.0 * dim / m
