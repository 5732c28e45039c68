"""Nearest neighbours over randomly rotated one-bit codes.

A vector, less the centre, is rotated at random and kept as the signs of its
coordinates, with two correction scalars: its norm and the inner product of its
direction with its code.  Queries are rotated too and quantised to four bits, so
the inner product with a code comes from counts of common bits.  The estimate's
error bound gives a lower bound of the distance; vectors whose bound lies under
the k-th best exact distance so far are reranked on the original vectors.

Vectors lie in coarse cells of about CELL_ROWS, codes beside them, in a written
table.  A query first searches its nearest cells; of the others it searches those
where a bound of the same kind leaves room for a vector nearer than its k-th best.
So what a query costs grows with the cells that may hold its neighbours, not with
the table.  A small table is a few cells, all of them searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.workspace import Workspace

#: Standard deviations in the error bound; bits of a query coordinate; seed of the rotation.
SIGMAS, QUERY_BITS, SEED = 2.0, 4, 17
#: Queries that one pass over the vectors answers (their number and size bound what is broadcast), rows that fit the centre.
PASS, SAMPLE = 4096, 4096
#: Vectors and queries compared at a time.
ROWS, COLS = 4096, 64
#: Rows of a cell, about; cells at most; nearest cells searched first; sampled rows a cell and rounds that fit the cells.
CELL_ROWS, CELLS, PROBED, CELL_SAMPLE, CELL_ROUNDS = 50_000, 4096, 4, 16, 10
#: Standard deviations in the bound of a cell.
CELL_SIGMAS = 4.0
SCHEMA = "query_id long, vec_id long, score double"


@dataclass
class Rotation:
    centre: np.ndarray
    matrix: np.ndarray  # orthogonal

    @staticmethod
    def fit(sample: np.ndarray) -> "Rotation":
        dim = sample.shape[1]
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
        return Rotation(sample.mean(axis=0), q * np.sign(np.diag(r)))


@dataclass
class Codes:
    """Packed sign bits (words of 64), and per vector the norm and the inner product of direction and code."""

    bits: np.ndarray
    ones: np.ndarray
    norm: np.ndarray
    align: np.ndarray


def _pack(b: np.ndarray) -> np.ndarray:
    pad = -b.shape[1] % 64
    b = np.pad(b, ((0, 0), (0, pad)))
    return np.packbits(b, axis=1, bitorder="little").view(np.uint64)


def encode(rotation: Rotation, x: np.ndarray) -> Codes:
    y = (x - rotation.centre) @ rotation.matrix
    norm = np.sqrt((y * y).sum(axis=1))
    align = np.abs(y).sum(axis=1) / np.sqrt(y.shape[1]) / np.where(norm > 0, norm, 1)
    b = y > 0
    return Codes(_pack(b), b.sum(axis=1), norm, np.where(norm > 0, align, 1.0))


def lower_bounds(rotation: Rotation, codes: Codes, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, vectors): estimated squared distances, and lower bounds that hold but for rare errors."""
    dim = queries.shape[1]
    y = (queries - rotation.centre) @ rotation.matrix
    norm = np.sqrt((y * y).sum(axis=1))
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-300)
    levels = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
    common = np.zeros((len(queries), len(codes.norm)))
    for j in range(QUERY_BITS):
        plane = _pack((levels >> j) & 1 == 1)
        count = np.zeros(common.shape, dtype=np.int64)
        for word in range(plane.shape[1]):
            count += np.bitwise_count(plane[:, word, None] & codes.bits[None, :, word])
        common += count << j
    # <code, y> for a code of +-1/sqrt(dim), from bits and the levels' total
    total = levels.sum(axis=1)
    inner = (2 * step[:, None] * common + 2 * low[:, None] * codes.ones - step[:, None] * total[:, None] - dim * low[:, None]) / np.sqrt(dim)
    estimate = inner / codes.align
    # Variances: of the code's part across its direction, and of the query's rounding.
    across = (1 - np.minimum(codes.align, 1) ** 2) / max(1, dim - 1)
    error = SIGMAS / codes.align * np.sqrt(across * (norm**2)[:, None] + (step**2)[:, None] / 12)
    square = norm[:, None] ** 2 + codes.norm**2
    return square - 2 * codes.norm * estimate, square - 2 * codes.norm * (estimate + error)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, coordinates added from first to last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


@dataclass
class Cells:
    """Coarse cells: centres, and how directions to a centre's vectors spread about those to other vectors."""

    centres: np.ndarray
    spread: float

    @staticmethod
    def fit(sample: np.ndarray, n: int) -> "Cells":
        rng = np.random.default_rng(SEED)
        c = sample[rng.choice(len(sample), n, replace=False)] if len(sample) > n else sample
        for _ in range(CELL_ROUNDS if len(c) > 1 else 0):
            near = Cells(c, 0).nearest(sample, 1)[:, 0]
            size = np.bincount(near, minlength=len(c))
            total = np.stack([np.bincount(near, x, minlength=len(c)) for x in sample.T], axis=1)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        if len(c) > 1:  # near cells get near numbers
            axis = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0]
            c = c[np.argsort((c @ axis).round(9), kind="stable")]
        out = Cells(c, 0.0)
        if len(c) > 1:
            near = out.nearest(sample, 1)[:, 0]
            other = rng.permutation(len(sample))
            apart = near != near[other]
            x, q = (sample - c[near])[apart], (sample[other] - c[near])[apart]
            norm = np.sqrt((x * x).sum(axis=1) * (q * q).sum(axis=1))
            cosine = (x * q).sum(axis=1) / np.where(norm > 0, norm, 1)
            out.spread = float(np.sqrt((cosine**2).mean())) if len(cosine) else 1.0
        return out

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(rows, cells)"""
        square = (x * x).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(axis=1)
        return np.sqrt(np.maximum(square, 0))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """(rows, n) cells, nearest first."""
        out = [np.argsort(self.distances(x[i : i + 4096]), axis=1, kind="stable")[:, :n] for i in range(0, len(x), 4096)]
        return np.concatenate(out) if out else np.zeros((0, min(n, len(self.centres))), np.int64)

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(queries, cells): lower bounds, but for rare errors, of the distance to vectors whose distance from the centre is in low to high."""
        d = self.distances(q)
        lean = np.minimum(1.0, CELL_SIGMAS * self.spread)
        r = np.clip(d * lean, low, high)  # where the bound is lowest
        return np.sqrt(np.maximum(d * d + r * r - 2 * lean * d * r, 0))


class Search:
    """Best k of a stream of vectors for each query of a pass; ``wanted`` lists the queries of each cell."""

    def __init__(self, rotation: Rotation, ids: np.ndarray, queries: np.ndarray, k: int, wanted: dict[int, np.ndarray] | None = None, limit: np.ndarray | None = None):
        self.rotation, self.ids, self.queries, self.k = rotation, ids, queries, k
        self.wanted = {0: np.arange(len(ids))} if wanted is None else wanted
        self.limit = np.full(len(ids), np.inf) if limit is None else limit
        self.best = [np.zeros((0, 2)) for _ in ids]  # distance, vec_id as float bits aside
        self.best_id = [np.zeros(0, np.int64) for _ in ids]
        self.reranked = 0

    def add(self, ids: np.ndarray, x: np.ndarray, cell: np.ndarray | None = None, codes: Codes | None = None) -> None:
        cell = np.zeros(len(ids), np.int64) if cell is None else cell
        codes = encode(self.rotation, x) if codes is None else codes
        for c in np.unique(cell):
            asked = self.wanted.get(int(c))
            if asked is None:
                continue
            own = np.flatnonzero(cell == c)
            for i in range(0, len(own), ROWS):
                rows = own[i : i + ROWS]
                part = Codes(codes.bits[rows], codes.ones[rows], codes.norm[rows], codes.align[rows])
                for j in range(0, len(asked), COLS):
                    block = asked[j : j + COLS]
                    guess, low = lower_bounds(self.rotation, part, self.queries[block])
                    for n, q in enumerate(block.tolist()):
                        self._merge(q, ids[rows], x[rows], guess[n], low[n])

    def _merge(self, q: int, ids: np.ndarray, v: np.ndarray, guess: np.ndarray, low: np.ndarray) -> None:
        reach = min(self.limit[q], self.best[q][-1] if len(self.best_id[q]) == self.k else np.inf)
        if np.isinf(reach):  # the nearest by estimate give a first reach
            first = np.argpartition(guess, min(self.k + 1, len(guess) - 1))[: self.k + 2]
            self._take(q, ids[first], v[first])
            if len(self.best_id[q]) == self.k:
                reach = self.best[q][-1]
        near = np.flatnonzero(low <= reach * reach * (1 + 1e-9))
        if len(near):
            self._take(q, ids[near], v[near])

    def _take(self, q: int, ids: np.ndarray, v: np.ndarray) -> None:
        new = ids != self.ids[q]
        if len(self.best_id[q]):
            new &= ~np.isin(ids, self.best_id[q])
        ids, v = ids[new], v[new]
        self.reranked += len(ids)
        d = distances(v, np.broadcast_to(self.queries[q], v.shape))
        d, ids = np.concatenate([self.best[q] if len(self.best_id[q]) else np.zeros(0), d]), np.concatenate([self.best_id[q], ids])
        order = np.lexsort((ids, d))[: self.k]
        self.best[q], self.best_id[q] = d[order], ids[order]

    def result(self) -> pa.RecordBatch:
        n = [len(x) for x in self.best_id]
        ids = np.repeat(self.ids, n)
        flat = lambda x, t: np.concatenate([np.asarray(y, dtype=t).reshape(-1) for y in x]) if sum(n) else np.zeros(0, t)
        best = [b if m else np.zeros(0) for b, m in zip(self.best, n, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flat(self.best_id, np.int64)), pa.array(flat(best, np.float64))], ["query_id", "vec_id", "score"])


def matrix(col: pa.Array) -> np.ndarray:
    """(rows, dim) doubles of a list column whose rows are all of one length."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _encoded(shared):
    """Cell, distance from its centre, and code of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, cells = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            cell = cells.nearest(x, 1)[:, 0]
            codes = encode(rotation, x)
            bits = pa.array([b.tobytes() for b in codes.bits], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.sqrt(((x - cells.centres[cell]) ** 2).sum(axis=1))), bits, pa.array(codes.ones.astype(np.int32)), pa.array(codes.norm), pa.array(codes.align), pa.array(cell.astype(np.int32))],
                ["vec_id", "v", "radius", "bits", "ones", "norm", "align", "cell"],
            )

    return run


_TABLE = "vec_id long, v array<double>, radius double, bits binary, ones int, norm double, align double, cell int"


def _homes(shared):
    """Nearest cell of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.nearest(matrix(batch.column(1)), 1)[:, 0].astype(np.int32))], ["vec_id", "v", "cell"])

    return run


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value)
        words = -(-search.queries.shape[1] // 64)
        for batch in batches:
            if batch.num_rows:
                own = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                number = lambda c: own[c].to_numpy()  # noqa: B023, E731
                bits = np.frombuffer(b"".join(own["bits"].to_pylist()), dtype=np.uint64).reshape(-1, words)
                search.add(number("vec_id"), matrix(own["v"]), number("cell"), Codes(bits, number("ones"), number("norm"), number("align")))
        yield search.result()

    return run


def _by_query(search_rows: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Queries of each cell, from pairs (query, cell)."""
    out: dict[int, list[int]] = {}
    for q, c in search_rows:
        out.setdefault(int(c), []).append(int(q))
    return {c: np.array(sorted(q)) for c, q in out.items()}


def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows that take part: id and vector there, components finite, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of ``vectors`` for each row of ``queries``: query_id, rank (from 1), vec_id, score (distance).

    Both tables have vec_id and v, as ``usable`` gives them; a query is not its own
    neighbour, whatever rows share its vec_id.  Rows that repeat a vec_id with the
    same vector count once; of several vectors under one vec_id the nearest counts,
    and of several queries under one vec_id the first in order of components asks.
    Vectors of different lengths never compare.  Ties go to the smaller vec_id.
    Queries are answered in passes of ``PASS`` (the broadcast's bound), each of which
    reads the cells that its queries need.  Cells and rotation are fitted on a bounded
    sample, but every row is in the index.  Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    counts = {r.dim: r.n for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sizes = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    ws, out = Workspace(spark), None
    for dim in sorted(d for d in counts if d in sizes):
        own = vectors.where(F.col("dim") == dim).select("vec_id", "v")
        asked = queries.where(F.col("dim") == dim).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v")
        found = _search_cells(ws, own, asked, dim, min(CELLS, -(-sizes[dim] // CELL_ROWS)), k)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return empty
    return ws.finish(_top(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _search_cells(ws: Workspace, own: DataFrame, asked: DataFrame, dim: int, n_cells: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the nearest of ``own(vec_id, v)`` to each of ``asked(vec_id, v)``, and of some more."""
    spark = own.sparkSession
    sample = matrix(own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, CELL_SAMPLE * n_cells)).toArrow().column("v").combine_chunks())
    rotation, cells = Rotation.fit(sample), Cells.fit(sample, n_cells)
    send = spark.sparkContext.broadcast
    table = own.mapInArrow(_encoded(send((rotation, cells))), _TABLE)
    # Ranges of cell and id: few files a cell, and a cell with a third of all rows is many tasks' work.
    table = ws.write(table.repartitionByRange("cell", "vec_id") if n_cells > 1 else table, "cell")
    asked = ws.write(asked.mapInArrow(_homes(send(cells)), "vec_id long, v array<double>, cell int"))
    low, high = np.full(len(cells.centres), np.inf), np.full(len(cells.centres), -np.inf)
    for r in table.groupBy("cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high")).collect():
        low[r.cell], high[r.cell] = r.low, r.high
    filled = np.flatnonzero(np.isfinite(low))
    first, passes = None, _passes(asked)
    for block in passes:
        ids, q = _block(asked, block)
        near = cells.nearest(q, PROBED)
        wanted = _by_query([(i, c) for i, row in enumerate(near) for c in row])
        some = table.where(F.col("cell").isin(list(wanted))).drop("radius").mapInArrow(_run(send((rotation, ids, q, k, wanted))), SCHEMA)
        first = some if first is None else first.unionAll(some)
    if len(cells.centres) <= PROBED:
        return first
    first = ws.write(_top(first, k).select("query_id", "vec_id", "score"))
    reached = ws.write(first.groupBy(F.col("query_id").alias("vec_id")).agg(F.max("score").alias("reach"), F.count("*").alias("n")))
    out = first
    for block in passes:
        ids, q = _block(asked, block)
        known = {r.vec_id: r.reach for r in _where(asked, block).select("vec_id").join(reached.where(F.col("n") == k), "vec_id").collect()}
        reach = np.array([known.get(int(i), np.inf) for i in ids])
        room = np.zeros((len(ids), len(low)), dtype=bool)
        room[:, filled] = cells.bounds(q, np.where(np.isfinite(low), low, 0), np.where(np.isfinite(high), high, 0))[:, filled] <= reach[:, None] * (1 + 1e-9)
        np.put_along_axis(room, cells.nearest(q, PROBED), False, axis=1)
        wanted = _by_query(np.argwhere(room).tolist())
        if wanted:
            some = table.where(F.col("cell").isin(list(wanted))).drop("radius").mapInArrow(_run(send((rotation, ids, q, k, wanted, reach))), SCHEMA)
            out = out.unionAll(some)
    return out


def _passes(asked: DataFrame) -> list[tuple[list[int], int, int]]:
    """(cells, part, parts): blocks of at most about PASS queries, those of near cells together."""
    out, cells, n = [], [], 0
    for r in sorted(asked.groupBy("cell").count().collect()):
        if r["count"] > PASS:  # a cell with many queries makes blocks of its own
            parts = -(-2 * r["count"] // PASS)
            out += [([r.cell], i, parts) for i in range(parts)]
            continue
        if n + r["count"] > PASS:
            out.append((cells, 0, 1))
            cells, n = [], 0
        cells, n = [*cells, r.cell], n + r["count"]
    return [*out, (cells, 0, 1)] if cells else out


def _where(asked: DataFrame, block: tuple[list[int], int, int]) -> DataFrame:
    cells, part, parts = block
    own = asked.where(F.col("cell").isin(cells))
    return own.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part) if parts > 1 else own


def _block(asked: DataFrame, block: tuple[list[int], int, int]) -> tuple[np.ndarray, np.ndarray]:
    rows = _where(asked, block).select("vec_id", "v").orderBy("vec_id").toArrow()
    return rows.column("vec_id").to_numpy(), matrix(rows.column("v").combine_chunks())


OP3_SQL = """
WITH u AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
d AS (
  SELECT q.vec_id AS query_id, u.vec_id,
    min(sqrt(list_reduce(list_transform(list_zip(q.v, u.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b))) AS score
  FROM u q JOIN u ON q.vec_id % 100 = 0 AND u.vec_id <> q.vec_id AND len(u.v) = len(q.v) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_one_bit_ann(spark, sf_dir: str) -> DataFrame:
    """Ten nearest of all embeddings for every hundredth."""
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where("vec_id % 100 = 0"), k=10)
