"""Reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: Sequence[DataFrame], k: int = RRF_K, weights: Sequence[float] | None = None, top: int | None = None) -> DataFrame:
    """(id, score) of ranked lists ``(id, rank)``: the sum of weight / (k + rank), best first, ties to the smaller id.

    k of 0 or less is 60; weights of the wrong number count as equal.
    """
    k = k if k > 0 else RRF_K
    if weights is None or len(weights) != len(lists):
        weights = [1.0] * len(lists)
    parts = [df.select("id", F.lit(i).alias("i"), (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("s")) for i, (df, w) in enumerate(zip(lists, weights, strict=True))]
    each = reduce(DataFrame.unionByName, parts)
    # Added in the lists' order, whatever order rows arrive in.
    sums = each.groupBy("id").agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), F.lit(0.0), lambda a, x: a + x).alias("score"))
    out = sums.orderBy(F.desc("score"), "id")
    return out if top is None else out.limit(top)


def with_rank(results: DataFrame, *order) -> DataFrame:
    """A bounded result list with its ranks from 1."""
    from pyspark.sql import Window

    return results.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = 10) -> DataFrame:
    """Fusion of a kNN list (id, distance) and a keyword list (id, score), each already cut to k: id, distance 0, score."""
    fused = rrf([with_rank(dense, "distance", "id"), with_rank(sparse, F.desc("score"), "id")], top=k)
    return fused.select("id", F.lit(0.0).alias("distance"), "score")
