"""Layered proximity graphs, one for each bounded shard of the vectors."""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import distance as D

#: Links a layer (twice on the lowest), beam while building, beam while searching; rows of a shard.
M, EF_BUILD, EF, SHARD_ROWS = 16, 200, 50, 5000
SEED = 3
GRAPH = "shard int, n long, graph binary"
#: Queries of one pass of a search.
PASS = 4096


class Graph:
    """Navigable small-world graph: random levels, beam search, links pruned to diverse neighbours."""

    def __init__(self, vectors: np.ndarray, metric: str):
        self.x, self.metric = vectors, metric
        self.level: list[int] = []
        self.links: list[list[list[int]]] = []
        self.entry = -1

    def far(self, q: np.ndarray, ids: Sequence[int]) -> np.ndarray:
        return D.rough(q[None], self.x[list(ids)], self.metric)[0]

    def beam(self, q: np.ndarray, start: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found from the starting nodes, nearest first."""
        seen = {i for _, i in start}
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [j for j in self.links[i][layer] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(self.far(q, new).tolist(), new, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def diverse(self, near: list[tuple[float, int]], limit: int) -> list[int]:
        """Nearest first, leaving out a node that is nearer to one taken than to the centre; filled up with the rest."""
        taken: list[int] = []
        for d, i in near:
            if len(taken) == limit:
                break
            if not taken or d <= self.far(self.x[i], taken).min():
                taken.append(i)
        for _, i in near:
            if len(taken) == limit:
                break
            if i not in taken:
                taken.append(i)
        return taken

    def add(self, level: int) -> None:
        i = len(self.level)
        q = self.x[i]
        self.level.append(level)
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = i
            return
        at = [(float(self.far(q, [self.entry])[0]), self.entry)]
        for layer in range(self.level[self.entry], -1, -1):
            if layer > level:
                at = self.beam(q, at[:1], 1, layer)
                continue
            at = self.beam(q, at, EF_BUILD, layer)
            limit = 2 * M if layer == 0 else M
            self.links[i][layer] = self.diverse(at, M)
            for j in self.links[i][layer]:
                own = self.links[j][layer]
                own.append(i)
                if len(own) > limit:
                    near = sorted(zip(self.far(self.x[j], own).tolist(), own, strict=True))
                    self.links[j][layer] = self.diverse(near, limit)
        if level > self.level[self.entry]:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int) -> list[int]:
        if self.entry < 0:
            return []
        at = [(float(self.far(q, [self.entry])[0]), self.entry)]
        for layer in range(self.level[self.entry], 0, -1):
            at = self.beam(q, at[:1], 1, layer)
        return [i for _, i in self.beam(q, at, max(ef, k), 0)]


    def pack(self, ids: np.ndarray) -> bytes:
        """The graph and its rows' ids as bytes."""
        flat = [layer for node in self.links for layer in node]
        out = io.BytesIO()
        ends = np.cumsum([len(x) for x in flat])
        np.savez(out, x=self.x, ids=ids, level=np.array(self.level), ends=ends, links=np.array([j for x in flat for j in x], dtype=np.int32), entry=self.entry)
        return out.getvalue()

    @staticmethod
    def unpack(content: bytes, metric: str) -> tuple["Graph", np.ndarray]:
        z = np.load(io.BytesIO(content))
        g = Graph(z["x"], metric)
        g.level, g.entry = z["level"].tolist(), int(z["entry"])
        flat = [x.tolist() for x in np.split(z["links"], z["ends"][:-1])] if len(z["ends"]) else []
        at = 0
        for level in g.level:
            g.links.append(flat[at : at + level + 1])
            at += level + 1
        return g, z["ids"]


def build_graphs(vectors: DataFrame, metric: str = "l2", shards: int | None = None) -> DataFrame:
    """The index as a table, one row a shard of about ``SHARD_ROWS`` vectors: (shard, n, graph).

    Written, it is searched without a shuffle: a shard's graph comes with its row.
    """
    shards = shards or max(1, -(-vectors.count() // SHARD_ROWS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        g, rng = Graph(np.stack(pdf["vector"].to_numpy()), metric), np.random.default_rng(SEED)
        for u in rng.random(len(pdf)):
            g.add(int(-math.log(1 - u) / math.log(M)))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(pdf)], "graph": [g.pack(pdf["id"].to_numpy())]})

    own = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("long").alias("id"), D.vector(F.col("vector")).alias("vector"))
    return own.groupBy("shard").applyInPandas(build, GRAPH)


def search_graphs(index: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", ef: int = EF) -> DataFrame:
    """Approximate kNN of a query table (qid, q) in every shard's graph, merged: qid, id, distance, score, rank.

    Queries are answered in passes of ``PASS``, which bounds what is broadcast.
    """
    spark, out = queries.sparkSession, None
    n = queries.count()
    passes = max(1, -(-2 * n // PASS)) if n > PASS else 1
    for i in range(passes):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i) if passes > 1 else queries
        asked = [(r.qid, np.asarray(r.q, dtype=np.float64)) for r in own.select("qid", D.vector(F.col("q")).alias("q")).collect()]
        found = index.select("graph").mapInArrow(_finder(spark.sparkContext.broadcast(asked), k, metric, ef), "qid long, id long, distance double")
        out = found if out is None else out.unionAll(found)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.select("qid", "id", "distance", D.score(F.col("distance"), metric).alias("score"), "rank")


def _finder(shared, k: int, metric: str, ef: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                g, ids = Graph.unpack(content.as_py(), metric)
                out = []
                for qid, q in shared.value:
                    near = g.search(q, k, ef) if len(q) == g.x.shape[1] else []
                    d = D.exact(np.broadcast_to(q, (len(near), len(q))), g.x[near], metric) if near else []
                    out += [(qid, int(ids[i]), float(e)) for i, e in zip(near, d, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["qid", "id", "distance"])

    return find
