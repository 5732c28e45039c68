"""Exact nearest neighbours and work on result lists."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.errors import DimensionMismatch
from skerry.functions import distance as D
from skerry.functions.filters import columns_of, compile_filter

#: Queries of one pass of ``batch_knn``: the bound of what is broadcast.
PASS = 4096
_CELLS = 1 << 20


def flat_knn(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "l2", dim: int | None = None) -> DataFrame:
    """The k rows of ``vectors(id, vector)`` nearest to a literal query: id, distance, score; ties to the smaller id.

    One pass with a partial top k in every task; k of 0 or less gives no row.
    """
    if dim is not None and len(query) != dim:
        raise DimensionMismatch(f"query has {len(query)} dimensions, the collection {dim}")
    d = D.metric(metric)(D.vector(F.col("vector")), D.vector(query))
    out = vectors.select("id", d.alias("distance")).orderBy("distance", "id").limit(max(0, k))
    return out.select("id", "distance", D.score(F.col("distance"), metric).alias("score"))


def _column(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def nearest_in_batches(ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
    """A mapInArrow function: the k nearest rows of its partition for every query, distances exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, rows = batch.column(0).to_numpy(), _column(batch.column(1))
            step = max(1, _CELLS // len(own))
            for lo in range(0, len(ids), step):
                guess = D.rough(queries[lo : lo + step], rows, metric)
                near = min(k, len(own))
                cut = np.partition(guess, near - 1, axis=1)[:, near - 1]
                # Candidates within rounding of the k-th; the reported distance is summed in order.
                slack = 1e-9 * (1 + np.abs(guess).max(axis=1))
                for i in range(len(guess)):
                    c = np.flatnonzero(guess[i] <= cut[i] + slack[i])
                    d = D.exact(np.broadcast_to(queries[lo + i], (len(c), rows.shape[1])), rows[c], metric)
                    d, x = np.concatenate([best[lo + i][0], d]), np.concatenate([best[lo + i][1], own[c]])
                    o = np.lexsort((x, d))[:k]
                    best[lo + i] = d[o], x[o]
        n = [len(x) for _, x in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, n)), pa.array(np.concatenate([x for _, x in best]) if len(ids) else np.zeros(0, np.int64)), pa.array(np.concatenate([d for d, _ in best]) if len(ids) else np.zeros(0))],
            ["qid", "id", "distance"],
        )

    return run


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """The k nearest of ``vectors(id, vector)`` for every row of ``queries(qid, q)``: qid, id, distance, score, rank.

    Every task keeps k rows a query, so only tasks * queries * k rows are shuffled.
    Queries are answered in passes of ``PASS`` (which bounds the broadcast).
    """
    D.metric(metric)
    spark = vectors.sparkSession
    k = max(0, k)
    rows = vectors.select(F.col("id").cast("long").alias("id"), D.vector(F.col("vector")).alias("vector"))
    n = queries.count()
    passes, out = max(1, -(-2 * n // PASS)) if n > PASS else 1, None
    for i in range(passes):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i) if passes > 1 else queries
        block = own.select(F.col("qid").cast("long").alias("qid"), D.vector(F.col("q")).alias("q")).toArrow()
        if not block.num_rows or not k:
            continue
        ids, matrix = block.column("qid").to_numpy(), _column(block.column("q").combine_chunks())
        found = rows.where(F.size("vector") == matrix.shape[1]).mapInArrow(nearest_in_batches(ids, matrix, k, metric), "qid long, id long, distance double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], "qid long, id long, distance double")
    return rank_top_k(out, k, metric)


def rank_top_k(found: DataFrame, k: int, metric: str) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "id", "distance", D.score(F.col("distance"), metric).alias("score"), "rank")


def filtered_knn(vectors: DataFrame, query: Sequence[float], spec: Mapping[str, Any] | None, k: int = 10, metric: str = "l2", mode: str = "pre") -> DataFrame:
    """kNN under a metadata filter on the other columns of ``vectors``.

    ``pre`` filters before the search (exact; the filter reaches the scan).  ``post``
    searches max(50, min(10 k, rows)) first, filters those and may return fewer than k.
    """
    if mode == "pre":
        return flat_knn(vectors.where(compile_filter(spec, columns_of(vectors))), query, k, metric)
    if mode != "post":
        raise ValueError("mode is 'pre' or 'post'")
    wide = max(50, min(10 * k, vectors.count()))
    d = D.metric(metric)(D.vector(F.col("vector")), D.vector(query))
    top = vectors.drop("vector").withColumn("distance", d) if "vector" not in vectors.columns else vectors.withColumn("distance", d).drop("vector")
    top = top.orderBy("distance", "id").limit(wide)
    kept = top.where(compile_filter(spec, columns_of(top))).orderBy("distance", "id").limit(max(0, k))
    return kept.select("id", "distance", D.score(F.col("distance"), metric).alias("score"))


def hydrate(results: DataFrame, metadata: DataFrame, key: str = "id") -> DataFrame:
    """Results with the metadata of their ids; ids without metadata stay.

    ``results`` is a bounded list (k rows a query of a pass): it is taken once, and the
    metadata are cut to its ids where they are scanned, so they are not shuffled.
    """
    spark = results.sparkSession
    few = spark.createDataFrame(results.toArrow(), results.schema)
    own = metadata.join(F.broadcast(few.select(key)), key, "left_semi")
    return few.join(F.broadcast(own), key, "left").select(*few.columns, *(c for c in metadata.columns if c != key))


def merge_results(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Top k of two lists (id, distance, score); an id in both counts as in the first."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    one = both.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_list", "distance"))).where("_n = 1")
    return one.drop("_list", "_n").orderBy("distance", "id").limit(max(0, k))


def scatter_gather(vectors: DataFrame, query: Sequence[float], k: int, shard: Column, shards: int, metric: str = "l2") -> DataFrame:
    """Top k of every shard, then of all; the same rows as ``flat_knn``."""
    d = D.metric(metric)(D.vector(F.col("vector")), D.vector(query))
    each = vectors.select("id", d.alias("distance"), shard.alias("shard"))
    local = each.withColumn("_n", F.row_number().over(Window.partitionBy("shard").orderBy("distance", "id"))).where(F.col("_n") <= k)
    return local.select("id", "distance", D.score(F.col("distance"), metric).alias("score")).orderBy("distance", "id").limit(k)


def recall_at_k(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, recall): the share of each query's true ids that were found; a query without true ids is not listed."""
    hit = found.select("qid", "id", F.lit(1).alias("hit")).distinct()
    return truth.join(hit, ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def delete(vectors: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Vectors without the deleted ids."""
    return vectors.join(tombstones.select("id").distinct(), "id", "left_anti")
