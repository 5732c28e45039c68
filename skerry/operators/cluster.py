"""K-means and inverted-file indexes (IVF, IVF-PQ and the posting-list profile)."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.errors import IndexNotBuilt
from skerry.functions import distance as D
from skerry.operators import quantize as Q

#: Cells, rounds, share of changed rows at which rounds stop, cells probed.
CELLS, ROUNDS, STOP, NPROBE = 256, 200, 0.001, 5
#: Changed rows from which an index is rebuilt, and their share.
REBUILD_ROWS, REBUILD_SHARE = 1024, 0.10


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _order_sums(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """(rows, centroids) exact distances, summed in order."""
    return np.stack([D.exact(x, np.broadcast_to(c, x.shape), metric) for c in centroids], axis=1)


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str = "l2", codebook: np.ndarray | None = None) -> DataFrame:
    """(id, cid, vector [, codes]): the nearest centroid, the lowest among equals; codes are those of what is left of the vector.

    Centroids and codebook are bounded matrices; one pass gives cell and codes.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((np.asarray(centroids, dtype=np.float64), codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, book = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                own = batch.slice(i, 4096)
                x = _matrix(own.column(1))
                cid = _order_sums(x, c, metric).argmin(axis=1)
                out = [own.column(0), pa.array(cid.astype(np.int32)), own.column(1)]
                if book is not None:
                    out.append(Q.code_lists(Q.pq_codes(x - c[cid], book)))
                yield pa.RecordBatch.from_arrays(out, ["id", "cid", "vector", "codes"][: len(out)])

    rows = vectors.select(F.col("id").cast("long").alias("id"), D.vector(F.col("vector")).alias("vector"))
    schema = "id long, cid int, vector array<double>" + (", codes array<short>" if codebook is not None else "")
    return rows.where(F.size("vector") == centroids.shape[1]).mapInArrow(run, schema)


def means(assigned: DataFrame) -> DataFrame:
    """(cid, pos, mean, size): cells' means, added up in every task first."""
    each = assigned.select("cid", F.posexplode("vector").alias("pos", "x"))
    return each.groupBy("cid", "pos").agg(F.avg("x").alias("mean"), F.count("*").alias("size"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k lowest ids."""
    rows = vectors.select("id", D.vector(F.col("vector")).alias("v")).orderBy("id").limit(k).collect()
    return np.array([r.v for r in rows])


def plus_plus(x: np.ndarray, k: int, metric: str, rng: np.random.Generator) -> np.ndarray:
    """k-means++ starting rows: the first at random, the next in proportion to the distance to those chosen."""
    chosen = [int(rng.integers(len(x)))]
    near = np.maximum(D.rough(x[chosen], x, metric)[0], 0)
    while len(chosen) < k:
        total = near.sum()
        i = int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(i)
        near = np.minimum(near, np.maximum(D.rough(x[i : i + 1], x, metric)[0], 0))
    return x[chosen].copy()


def kmeans(vectors: DataFrame, k: int = CELLS, metric: str = "l2", rounds: int = ROUNDS, init: str = "++", seed: int = 42, sample: int = 100_000) -> np.ndarray:
    """Centroids by Lloyd's rounds on the ``sample`` rows lowest by a hash of id (all rows of a smaller table).

    With no more rows than k each row is its own centroid.  An emptied cell takes the
    row farthest from its centroid; rounds stop when under 0.1 % of rows changed cell.
    """
    rows = vectors.select("id", D.vector(F.col("vector")).alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    x = _matrix(rows.column("v").combine_chunks())
    if len(x) <= k:
        return x[np.argsort(rows.column("id").to_numpy())]
    rng = np.random.default_rng(seed)
    c = plus_plus(x, k, metric, rng) if init == "++" else x[rng.choice(len(x), k, replace=False)].copy()
    old = np.full(len(x), -1)
    for i in range(rounds):
        d = D.rough(x, c, metric)
        near = d.argmin(axis=1)
        if i and (near != old).sum() < STOP * len(x):
            break
        old = near
        size = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        far = np.argsort(-d[np.arange(len(x)), near])
        for n, cell in enumerate(np.flatnonzero(size == 0)):
            c[cell] = x[far[n]]
    return c


def nearest_cells(query: Sequence[float], centroids: np.ndarray, nprobe: int, metric: str = "l2") -> list[int]:
    """The nprobe nearest cells, nearest first, lowest among equals; all if there are fewer."""
    d = _order_sums(np.asarray([query], dtype=np.float64), np.asarray(centroids), metric)[0]
    return np.lexsort((np.arange(len(d)), d))[: max(1, nprobe)].tolist()


def stale(changed: int) -> bool:
    """True if so many rows have changed since the build that the index is to be built again."""
    return changed > max(100, int(REBUILD_ROWS * REBUILD_SHARE))


@dataclass
class IvfIndex:
    """Vectors in cells, and a buffer of vectors that came after the build."""

    centroids: np.ndarray
    lists: DataFrame  # id, cid, vector [, codes]
    metric: str = "l2"
    codebook: np.ndarray | None = None
    buffer: DataFrame | None = None
    path: str | None = field(default=None)

    def search(self, query: Sequence[float], k: int = 10, nprobe: int = NPROBE, dead: DataFrame | None = None) -> DataFrame:
        """Top k of the probed cells and the buffer, but for the ids in ``dead`` (a bounded table): id, distance, score.

        Cells are literals, so a table partitioned by cid reads only their folders.
        With a codebook, 10 k candidates by codes are reranked exactly.
        """
        cells = nearest_cells(query, self.centroids, nprobe, self.metric)
        own = self.lists.where(F.col("cid").isin(cells))
        if dead is not None:
            own = own.join(F.broadcast(dead), "id", "left_anti")
        if self.codebook is not None:
            own = self._by_codes(own, query, cells).orderBy("approx", "id").limit(Q.OVERSAMPLE * k)
        rows = own.select("id", "vector")
        if self.buffer is not None:
            rows = rows.unionByName(self.buffer.select("id", D.vector(F.col("vector")).alias("vector")).join(rows.select("id"), "id", "left_anti"))
        d = D.metric(self.metric)(F.col("vector"), D.vector(query))
        top = rows.select("id", d.alias("distance")).orderBy("distance", "id").limit(max(0, k))
        return top.select("id", "distance", D.score(F.col("distance"), self.metric).alias("score"))

    def _by_codes(self, rows: DataFrame, query: Sequence[float], cells: list[int]) -> DataFrame:
        """(id, vector, approx): each cell has a table of the distances of the query, less its centroid, to the codewords."""
        tables = {c: np.array(Q.pq_table(np.asarray(query, dtype=np.float64) - self.centroids[c], self.codebook)) for c in cells}
        shared = rows.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cid, codes = batch.column(1).to_numpy(), _matrix(batch.column(3)).astype(np.int64)
                approx = np.zeros(batch.num_rows)
                for c in np.unique(cid):
                    own = cid == c
                    table = shared.value[int(c)]
                    for part in range(codes.shape[1]):
                        approx[own] += table[part, codes[own, part]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(approx)], ["id", "vector", "approx"])

        return rows.select("id", "cid", "vector", "codes").mapInArrow(run, "id long, vector array<double>, approx double")

    def needs_rebuild(self) -> bool:
        return self.buffer is not None and stale(self.buffer.count())

    def export(self) -> DataFrame:
        return self.lists.select("id", "vector")


def build_ivf(vectors: DataFrame, cells: int = CELLS, metric: str = "l2", parts: int = 0, path: str | None = None, init: str = "++", rounds: int = ROUNDS, codewords: int = Q.CODEWORDS) -> IvfIndex:
    """Cluster, assign every row and, with ``path``, write the lists partitioned by cell; ``parts`` adds PQ codes."""
    if parts and metric != "l2":
        raise ValueError("codes are compared in l2 only")
    centroids = kmeans(vectors, cells, metric, rounds, init)
    if not len(centroids):
        raise IndexNotBuilt("no vectors")
    book = None
    if parts:  # codes are of what the centroid leaves of a vector
        x = Q.sample_matrix(vectors)
        book = Q.pq_fit(x - centroids[_order_sums(x, centroids, metric).argmin(axis=1)], parts, codewords)
    lists = assign(vectors, centroids, metric, book)
    if path:
        lists.repartition("cid").write.mode("overwrite").partitionBy("cid").parquet(path)
        lists = vectors.sparkSession.read.schema(lists.schema).parquet(path)
    return IvfIndex(centroids, lists, metric, book, path=path)


def pack(index: IvfIndex) -> bytes:
    """Centroids and codebook as bytes; the lists are a table of their own."""
    out = io.BytesIO()
    np.savez(out, centroids=index.centroids, **({} if index.codebook is None else {"codebook": index.codebook}))
    return out.getvalue()


def unpack(spark: SparkSession, content: bytes, path: str, metric: str) -> IvfIndex:
    """The index whose lists were written to ``path``."""
    model = np.load(io.BytesIO(content))
    book = model["codebook"] if "codebook" in model else None
    schema = "id long, vector array<double>, " + ("codes array<short>, " if book is not None else "") + "cid int"
    return IvfIndex(model["centroids"], spark.read.schema(schema).parquet(path), metric, book, path=path)


def build_posting_lists(vectors: DataFrame, cells: int = CELLS, metric: str = "l2", path: str | None = None) -> IvfIndex:
    """The posting-list profile: random start (seed 42), 20 rounds."""
    return build_ivf(vectors, cells, metric, path=path, init="random", rounds=20)


def ivf_batch(index: IvfIndex, queries: DataFrame, k: int = 10, nprobe: int = NPROBE) -> DataFrame:
    """kNN of many queries: each goes to its cells by an equi-join on cid (no query meets all rows)."""
    from skerry.operators.knn import rank_top_k

    cells = np.asarray(index.centroids)
    shared, metric = queries.sparkSession.sparkContext.broadcast(cells), index.metric

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _order_sums(_matrix(batch.column(1)), shared.value, metric)
                near = np.argsort(d, axis=1, kind="stable")[:, :nprobe].astype(np.int32)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(near.reshape(-1))], ["qid", "q", "cid"])

    asked = queries.select(F.col("qid").cast("long").alias("qid"), D.vector(F.col("q")).alias("q")).mapInArrow(probe, "qid long, q array<double>, cid int")
    d: Column = D.metric(metric)(F.col("vector"), F.col("q"))
    return rank_top_k(asked.join(index.lists, "cid").select("qid", "id", d.alias("distance")), k, metric)
